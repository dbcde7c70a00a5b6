"""The corpus pipeline: documents in, packed sequences out.

Each stage takes ``(spark, docs, sf_dir)``, where ``docs`` is what its
predecessor kept, and returns a DataFrame that is written as Parquet and read
again as the next stage's ``docs``. All but the last return the columns of
``documents``.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kindred.llm import contentsort, fairmix, hilbert, jaccardjoin, toxicity
from kindred.llm.common import table
from kindred.llm.tokens import vocabulary_path
from kindred.session import scratch_path, ship_package

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents whose calibrated toxicity score is 0.5 or more."""
    ship_package(spark)
    index, read = toxicity.fit_and_read(docs.select(COLUMNS), table(spark, sf_dir, "labels", "doc_id", "toxic"),
                                        text_kept=True)
    return toxicity.score_read(read, index, evidence=False) \
        .where("predicted = 0").select(COLUMNS)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents with equal normalised texts, the one with the smallest id stays."""
    return contentsort.drop_exact_copies(docs.select(COLUMNS))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of near copies, the document with the smallest id stays."""
    ship_package(spark)
    return jaccardjoin.keep_one_per_group(docs.select(COLUMNS))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it."""
    return fairmix.draw_mix(docs.select(COLUMNS))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in sequences of 2048 ids, neighbours on the curve side by side."""
    ship_package(spark)
    return hilbert.pack(docs.select(COLUMNS), vocabulary_path("word_bpe_49k.json"))


STAGES = [("toxicity", drop_toxic), ("exact_dedup", drop_copies), ("near_dedup", drop_near_copies),
          ("mixing", mix_sources), ("packing", pack_sequences)]

# Tokenizers, models and similarity joins are beyond SQL; tests/llm/test_pipeline.py
# compares each stage function, on its own input, with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents", *COLUMNS)
    at = scratch_path(spark, f"pipeline-{uuid.uuid4().hex}")
    for name, stage in STAGES[:-1]:
        stage(spark, docs, sf_dir).write.parquet(f"{at}/{name}")
        docs = spark.read.parquet(f"{at}/{name}")
    return STAGES[-1][1](spark, docs, sf_dir).select(
        "doc_id", F.col("start"), "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")
