"""Sampling, split and limits: T1, T2, T4, T5, X1.

Draws are decided by an md5 of ``id:seed``, so they are stable across runs,
partitionings and engines (no ``rand()``); the fraction test compares the
first 8 hex digits with a fixed bound.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def hash_key(id_col: str, seed: int) -> F.Column:
    return F.md5(F.concat_ws(":", F.col(id_col).cast("string"), F.lit(str(seed))))


def fraction_bound(fraction: float) -> str:
    return format(min(int(round(fraction * 16 ** 8)), 16 ** 8 - 1), "08x")


def split(df: DataFrame, id_col: str, test_fraction: float = 0.25, seed: int = 0):
    """Exact, stable train/test split (test when the hash falls below the bound)."""
    is_test = F.substring(hash_key(id_col, seed), 1, 8) < F.lit(fraction_bound(test_fraction))
    x = df.withColumn("__test", is_test)
    return x.where(~F.col("__test")).drop("__test"), x.where(F.col("__test")).drop("__test")


def sample_k(df: DataFrame, id_col: str, k: int, seed: int = 0) -> DataFrame:
    """Exactly ``min(k, N)`` rows without replacement (a top-k by hash)."""
    return df.withColumn("__h", hash_key(id_col, seed)).orderBy("__h", id_col).limit(k).drop("__h")


def drawn_from(df: DataFrame, choice: DataFrame, id_col: str) -> DataFrame:
    """Rows whose id a stored choice names (Catalyst picks the join; no hint)."""
    return df.join(choice.select(id_col), id_col, "left_semi")


def rest_of(df: DataFrame, choice: DataFrame, id_col: str) -> DataFrame:
    """Rows whose id it does not name (null ids are never drawn)."""
    return df.join(choice.select(id_col), id_col, "left_anti")


def top_n_per_group(df: DataFrame, group_col: str, order, n: int, salts: int = 16) -> DataFrame:
    """T5: first ``n`` rows of each group in the given order (ties broken by
    the order only). Exact in two steps: the top ``n`` of each (group, salt)
    slice, then the top ``n`` of the at most ``n * salts`` survivors per group,
    so a group holding a third of all rows is cut down by many tasks first."""
    order = order if isinstance(order, (list, tuple)) else [order]
    salt = F.pmod(F.xxhash64(*[F.col(c) for c in df.columns]), F.lit(salts))
    x = df.withColumn("__s", salt)
    w1 = Window.partitionBy(group_col, "__s").orderBy(*order)
    x = x.withColumn("__r", F.row_number().over(w1)).where(F.col("__r") <= n).drop("__r", "__s")
    w2 = Window.partitionBy(group_col).orderBy(*order)
    return x.withColumn("__r", F.row_number().over(w2)).where(F.col("__r") <= n).drop("__r")
