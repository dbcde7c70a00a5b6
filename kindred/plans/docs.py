"""The document pipeline over the driver tables, one function per stage.

``documents`` stand for units (``doc_id`` -> ``unit_id``); ``labels`` for the
label report. Settings mirror the reference's defaults: vocabulary cut 2000
names with at least 20 occurrences after cleaning, cosine cut 0.4, clusters
kept above 15 members.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kindred.operators import components as C
from kindred.operators import pairs as N
from kindred.operators import vectorize as V
from kindred.operators import vocab as VO
from kindred.session import cut_lineage, store
from kindred.sources.tables import load, units_from_documents


@dataclass(frozen=True)
class Settings:
    vocab_take: int = 2000
    vocab_skip: int = 0
    vocab_min: int = 20
    t_cosine: float = 0.4
    t_jaccard: float = 0.5
    min_cluster: int = 15
    top_n: int = 200


DEFAULT = Settings()

# Stage tables already written in this Spark application, by (stage, folder,
# settings): a query that needs the counts or the components twice builds
# them once (the S11 reuse). They live in the shared folder.
_STAGES: dict = {}


def _stage(spark: SparkSession, key: tuple, build):
    k = (spark.sparkContext.applicationId,) + key
    if k not in _STAGES:
        _STAGES[k] = build()
    return _STAGES[k]


def reset_stages() -> None:
    """Forget stored stages (each later query builds its own again)."""
    _STAGES.clear()


def units(spark: SparkSession, sf_dir: str) -> DataFrame:
    return units_from_documents(spark, sf_dir)


def tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return VO.token_stream(units(spark, sf_dir))


def frequency(spark: SparkSession, sf_dir: str) -> DataFrame:
    return VO.token_frequency(tokens(spark, sf_dir))


def vocabulary(spark: SparkSession, sf_dir: str, s: Settings = DEFAULT) -> DataFrame:
    """The cut vocabulary (at most ``vocab_take`` rows), from one pass over the words."""
    def build():
        clean = VO.clean_vocabulary(frequency(spark, sf_dir))
        return cut_lineage(VO.cut_vocabulary(clean, s.vocab_take, s.vocab_skip, s.vocab_min))
    return _stage(spark, ("vocabulary", sf_dir, s), build)


def counts(spark: SparkSession, sf_dir: str, s: Settings = DEFAULT, binary: bool = False,
           stage: bool = True) -> DataFrame:
    """Term counts over the cut vocabulary (broadcast join, at most ``vocab_take``
    rows). The words are counted where the text is read, and only words of the
    vocabulary are stored; the stage table is computed once and read by the unit
    count, the document frequency and the weights."""
    c = _stage(spark, ("counts", sf_dir, s), lambda: store(
        V.term_counts(units(spark, sf_dir), vocabulary(spark, sf_dir, s))))
    if binary:
        c = c.withColumn("cnt", F.lit(1).cast("long"))
    return c


def weights(spark: SparkSession, sf_dir: str, s: Settings = DEFAULT) -> DataFrame:
    return _stage(spark, ("weights", sf_dir, s), lambda: store(V.tfidf(counts(spark, sf_dir, s))))


def cosine_pairs(spark: SparkSession, sf_dir: str, s: Settings = DEFAULT,
                 forest: bool = False) -> DataFrame:
    w = weights(spark, sf_dir, s)
    return N.cosine_within(w, s.t_cosine, dim=s.vocab_take + 1, forest=forest)


def components(spark: SparkSession, sf_dir: str, s: Settings = DEFAULT) -> DataFrame:
    def build():
        w = weights(spark, sf_dir, s)
        pairs = N.cosine_within(w, s.t_cosine, dim=s.vocab_take + 1, forest=True)
        nodes = w.select("unit_id").distinct()
        return cut_lineage(C.connected_components(pairs, nodes, node_col="unit_id"))
    return _stage(spark, ("components", sf_dir, s), build)


def labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "labels", "doc_id", "quality", "toxic") \
        .withColumnRenamed("doc_id", "unit_id")


def cluster_report(spark: SparkSession, sf_dir: str, s: Settings = DEFAULT) -> DataFrame:
    """C6 on single-link clusters: size and label rates of each kept cluster."""
    comp = components(spark, sf_dir, s)
    sizes = C.component_sizes(comp).where(F.col("size") > s.min_cluster)
    members = comp.join(sizes, "component").join(labels(spark, sf_dir), "unit_id", "left")
    return members.groupBy(F.col("component").alias("cluster_id")).agg(
        F.count(F.lit(1)).alias("size"),
        F.count("toxic").alias("n_labelled"),
        F.coalesce(F.sum("toxic"), F.lit(0)).cast("long").alias("n_toxic"),
        F.round(F.avg("toxic"), 6).alias("toxic_rate"),
        F.round(F.avg("quality"), 6).alias("quality_rate"))
