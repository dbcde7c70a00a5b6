"""Vocabulary building: A1 token frequency, P2, T3 order, P4 clean, P5 cut, T1.

Order everywhere: frequency descending, then name descending (T3).
Ranking the full vocabulary is a distributed sort (``orderBy``); a cut to the
first ``n`` is a top-n (per-partition top-n then merge), so no step pulls the
whole vocabulary into one task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kindred.functions import text as T


def token_stream(units: DataFrame, text_col: str = "text",
                 id_col: str = "unit_id") -> DataFrame:
    """V1 words of each unit, one row per occurrence: ``unit_id, token``."""
    return units.select(F.col(id_col).alias("unit_id"),
                        F.explode(T.words(text_col)).alias("token"))


def token_frequency(tokens: DataFrame, token_col: str = "token",
                    min_length: int = 3) -> DataFrame:
    """A1 + P2: ``name, frequency`` over tokens of at least ``min_length`` chars.

    The length is measured before lowering (as the reference does).
    """
    t = F.col(token_col)
    return (tokens.where(t.isNotNull() & (F.char_length(t) >= min_length))
            .groupBy(F.lower(t).alias("name"))
            .agg(F.count(F.lit(1)).alias("frequency")))


def frequency_from_counts(word_counts: DataFrame, token_col: str = "token",
                          min_length: int = 3) -> DataFrame:
    """A1 + P2 from per-unit word counts (``unit_id, token, cnt``)."""
    t = F.col(token_col)
    return (word_counts.where(t.isNotNull() & (F.char_length(t) >= min_length))
            .groupBy(F.lower(t).alias("name"))
            .agg(F.sum("cnt").cast("long").alias("frequency")))


def vocabulary_order():
    """T3 order as sort expressions."""
    return [F.desc("frequency"), F.desc("name")]


def sort_vocabulary(freq: DataFrame) -> DataFrame:
    """Distributed sort, frequency desc then name desc."""
    return freq.orderBy(*vocabulary_order())


def clean_vocabulary(freq: DataFrame, name_col: str = "name") -> DataFrame:
    """Keep names matching ``^[a-zA-Z_]+\\d*$``."""
    return freq.where(T.is_clean_name(name_col))


def cut_vocabulary(freq: DataFrame, take: int = 2000, skip: int = 0,
                   min_occurrences: int = 20, inclusive: bool = False) -> DataFrame:
    """P5: ranks ``skip+1 .. skip+take`` (``+1`` more when ``inclusive``, as the
    reference's off-by-one does), stopping at the first frequency below
    ``min_occurrences``. Returns ``name, frequency, idx`` with ``idx`` 0-based
    in vocabulary order; at most ``take (+1)`` rows, so it is safe to broadcast.
    """
    n = take + (1 if inclusive else 0)
    top = freq.where(F.col("frequency") >= min_occurrences) \
        .orderBy(*vocabulary_order()).limit(skip + n)
    w = Window.orderBy(*vocabulary_order())  # over <= skip+n rows only
    ranked = top.withColumn("rank", F.row_number().over(w))
    return (ranked.where(F.col("rank") > skip)
            .select("name", "frequency", (F.col("rank") - skip - 1).cast("int").alias("idx")))


def top_n_vocabulary(tokens: DataFrame, n: int, token_col: str = "token") -> DataFrame:
    """V3: fitted vocabulary of the ``n`` most frequent words (ties: word asc).

    Same tie rule as a count vectoriser fitted with ``max_features``.
    """
    freq = tokens.groupBy(F.col(token_col).alias("name")).agg(
        F.count(F.lit(1)).alias("frequency"))
    top = freq.orderBy(F.desc("frequency"), F.asc("name")).limit(n)
    w = Window.orderBy(F.desc("frequency"), F.asc("name"))
    return top.select("name", "frequency", (F.row_number().over(w) - 1).cast("int").alias("idx"))


def sample_files_with_replacement(files: DataFrame, fraction: float, seed: int = 0,
                                  id_col: str = "file_idx") -> DataFrame:
    """``k = int(n * fraction)`` draws with replacement from ``files``.

    ``files`` carries a dense 0-based ``id_col``. Draw ``r`` picks
    ``floor(u_r * n)`` where ``u_r`` comes from a seeded hash of ``r``; a file may
    be drawn (and later counted) more than once.
    """
    spark = files.sparkSession
    n = files.count()
    k = int(n * fraction)
    draws = spark.range(k).select(
        F.col("id").alias("draw"),
        F.floor(_unit_hash(F.col("id"), seed) * F.lit(n)).cast("long").alias(id_col))
    return draws.join(files, id_col, "inner")


def _unit_hash(c, seed: int):
    """Deterministic number in [0, 1) from md5 of ``c`` and ``seed``."""
    h = F.md5(F.concat_ws(":", c.cast("string"), F.lit(str(seed))))
    return F.conv(F.substring(h, 1, 13), 16, 10).cast("double") / F.lit(float(16 ** 13))
