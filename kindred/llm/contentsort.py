"""Exact duplicates by a content sort (DataFrame functions only).

The normalised texts are range-partitioned by sampled splitters, sorted
externally inside each partition so that equal texts are neighbours, and
compared in full with their neighbours (the window's grouping test); the
smallest identifier of each run of equals stays.

* The splitter key is the first 32 characters of the normalised text and its
  SHA-256, never the whole text: splitters stay small on the driver, texts
  that share a long opening still spread over partitions, and the sort order
  stays that of the content. Equality is decided on whole texts only.
* One text may hold a third of all rows. Texts with at least
  ``max(min_hot, rows / 10000)`` copies (at most 10,000 such texts, whatever
  the size of the corpus) get a salt in the key, one salt per so many copies.
  Each salted slice is sorted and compared like any other text; its first row
  (one per slice, with its whole text) then goes through a second content sort
  that merges the slices. No copy group meets in one task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kindred.llm.common import SPACE, stage, whole_text

MAX_HOT = 10_000


def normalise(col: str = "text"):
    """Runs of the six ASCII white space characters become one space."""
    return F.regexp_replace(whole_text(col), SPACE, " ")


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                 min_hot: int = 256) -> DataFrame:
    """``doc_id, keep_id, group_size, kept, text_sha256``: one row per input row.

    Null text counts as empty. Of equal texts the smallest id stays (a null id
    loses against any other); of repeated rows with that id exactly one has
    ``kept`` true. An empty table gives an empty result. Other columns of
    ``docs`` are ignored, whatever their names.
    """
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"),
                       normalise(text_col).alias("norm"))
    hot = _hot_texts(base, min_hot)
    keyed = base.withColumn("h", F.xxhash64("norm")).join(F.broadcast(hot), "h", "left").select(
        "doc_id", "norm", F.sha2(F.col("norm").cast("binary"), 256).alias("sha"),
        F.substring("norm", 1, 32).alias("head"), "salts",
        F.when(F.col("salts").isNull(), F.lit(0)).otherwise(
            F.expr("pmod(xxhash64(doc_id, 11), salts)")).cast("int").alias("salt"))
    hot_row = F.col("salts").isNotNull()
    key = ["head", "sha", "salt"]
    run = Window.partitionBy(*key, "norm")
    first = run.orderBy(F.col("doc_id").asc_nulls_last())
    runs = keyed.repartitionByRange(*key).select(
        "doc_id", "sha", "salt", hot_row.alias("hot"),
        F.row_number().over(first).alias("place"),
        F.first("doc_id").over(first).alias("run_id"),
        F.count(F.lit(1)).over(run).alias("run_size"),
        F.when(hot_row & (F.row_number().over(first) == 1), F.col("norm")).alias("slice_text"))
    runs = stage(runs, "content-sort")

    # One row per slice of a hot text: at most 2 * MAX_HOT rows.
    slices = runs.where("hot and place = 1").select(
        "sha", "salt", F.col("slice_text").alias("norm"), "run_id", "run_size",
        F.substring("slice_text", 1, 32).alias("head"))
    same = Window.partitionBy("head", "sha", "norm")
    order = same.orderBy(F.col("run_id").asc_nulls_last(), "salt")
    merged = slices.repartitionByRange("head", "sha").select(
        "sha", "salt", F.first("run_id").over(order).alias("all_id"),
        F.sum("run_size").over(same).alias("all_size"),
        (F.row_number().over(order) == 1).alias("leads"))
    return runs.join(F.broadcast(merged), ["sha", "salt"], "left").select(
        "doc_id",
        F.when(F.col("hot"), F.col("all_id")).otherwise(F.col("run_id")).alias("keep_id"),
        F.when(F.col("hot"), F.col("all_size")).otherwise(F.col("run_size")).cast("long")
        .alias("group_size"),
        ((F.col("place") == 1) & (~F.col("hot") | F.coalesce(F.col("leads"), F.lit(False))))
        .alias("kept"),
        F.col("sha").alias("text_sha256"))


def _hot_texts(base: DataFrame, min_hot: int) -> DataFrame:
    """``h, salts`` of the texts with very many copies; at most ``MAX_HOT`` rows.

    Counted over all rows on 64-bit hashes alone (a partial count per task
    precedes the shuffle, so a hot hash moves once per task). The hash only
    decides who is salted, never who is equal.
    """
    share = max(min_hot, -(-base.count() // MAX_HOT))
    counts = base.groupBy(F.xxhash64("norm").alias("h")).agg(F.count(F.lit(1)).alias("n"))
    return stage(counts.where(F.col("n") >= share)
                 .select("h", F.ceil(F.col("n") / share).cast("long").alias("salts")), "hot-texts")


def drop_exact_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns.

    Works on any columns: decisions are joined back on the id and the text's
    digest; of fully repeated rows one stays.
    """
    keep = exact_groups(docs, id_col, text_col).where("kept") \
        .select(F.col("doc_id").alias("__id"), F.col("text_sha256").alias("__sha"))
    tagged = docs.withColumn("__sha", F.sha2(normalise(text_col).cast("binary"), 256))
    hit = tagged.alias("d").join(
        keep.alias("k"), F.col(f"d.{id_col}").cast("long").eqNullSafe(F.col("k.__id"))
        & (F.col("d.__sha") == F.col("k.__sha")), "left_semi")
    return hit.drop("__sha").dropDuplicates([id_col, text_col])
