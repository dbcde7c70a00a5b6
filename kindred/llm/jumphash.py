"""Shards by jump consistent hashing.

A row's shard follows from its key and the shard count alone: no ring, no
table. One more shard takes ``1/(n+1)`` of the rows, all into itself. The jump
loop runs on numpy arrays of keys (a few dozen multiplications for a whole
Arrow batch), everything else is Spark SQL.

Slots (a gapless numbering inside each shard) are two-level: rows fall into
slices by a hash, slice sizes are summed in a window over the slices of a
shard, and only rows of one slice meet in a sort, so a shard is numbered by
many tasks.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kindred.llm.common import crc32_of, stage, whole_text

SLICES = 256
NULL_KEY = -(1 << 62)

# The multiplier of the published jump hash.
MULTIPLIER = 2862933555777941757


def jump(keys: np.ndarray, buckets: int) -> np.ndarray:
    """Bucket in ``[0, buckets)`` of each 64-bit key."""
    state = keys.astype(np.int64).view(np.uint64).copy()
    at = np.full(len(state), -1, np.int64)
    nxt = np.zeros(len(state), np.int64)
    live = np.arange(len(state))
    with np.errstate(over="ignore"):
        while len(live):
            at[live] = nxt[live]
            state[live] = state[live] * np.uint64(MULTIPLIER) + np.uint64(1)
            draw = (state[live] >> np.uint64(33)).astype(np.float64) + 1.0
            nxt[live] = ((at[live] + 1) * (float(1 << 31) / draw)).astype(np.int64)
            live = live[nxt[live] < buckets]
    return at


def jump_shard(key, shards: int):
    """Column: the shard of a long key (null keys count as one fixed key)."""
    @F.pandas_udf("int")
    def shard(k: pd.Series) -> pd.Series:
        return pd.Series(jump(k.to_numpy(np.int64), shards).astype(np.int32))
    return shard(F.coalesce(key.cast("long"), F.lit(NULL_KEY)))


def assign_shards(docs: DataFrame, shards: int = 24, id_col: str = "doc_id",
                  text_col: str = "text") -> DataFrame:
    """``doc_id, size, text_crc32, law, shard, slot, grown_shard`` per input row.

    ``size`` is the text's UTF-8 bytes plus 8 (null text: 8, crc of nothing).
    Repeated rows share a shard and get slots of their own; an empty table
    gives an empty result. Other columns are ignored, whatever their names.
    """
    text = whole_text(text_col)
    d = docs.select(F.col(id_col).cast("long").alias("doc_id"),
                    (F.octet_length(text) + 8).cast("long").alias("size"),
                    crc32_of(text).alias("text_crc32"))
    d = d.withColumn("shard", jump_shard(F.col("doc_id"), shards)) \
        .withColumn("grown_shard", jump_shard(F.col("doc_id"), shards + 1)) \
        .withColumn("slice", F.expr(f"pmod(xxhash64(doc_id, size, text_crc32), {SLICES})").cast("int"))
    d = stage(d, "shards")
    sizes = d.groupBy("shard", "slice").agg(F.count(F.lit(1)).alias("n"))
    past = Window.partitionBy("shard").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("shard", "slice", F.coalesce(F.sum("n").over(past), F.lit(0)).alias("first"))
    place = Window.partitionBy("shard", "slice").orderBy("doc_id", "size", "text_crc32")
    # starts has at most SLICES rows per shard
    return d.withColumn("place", F.row_number().over(place)) \
        .join(F.broadcast(starts), ["shard", "slice"]) \
        .select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard",
                (F.col("first") + F.col("place") - 1).cast("long").alias("slot"), "grown_shard")


def write_shards(docs: DataFrame, path: str, shards: int = 24, id_col: str = "doc_id") -> None:
    """Write whole rows into ``shard=N`` folders, several files per shard."""
    s = docs.withColumn("shard", jump_shard(F.col(id_col), shards))
    s.repartition("shard", F.expr(f"pmod(xxhash64({id_col}), 16)")).write.partitionBy("shard").parquet(path)
