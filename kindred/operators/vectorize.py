"""Vectorisation: V1-V5, A2-A5, A9, P6, P12, J4, J6.

Long sparse form everywhere: ``unit_id, idx, cnt`` / ``unit_id, idx, w``.

Partitioning: a unit is one row, so the words of its text are counted inside that
row, without a hash table or a shuffle; only ids that come several times (looked up
first) have their rows' counts added. The vocabulary join is a broadcast, bounded by the cut; the per-unit norm
windows and vector builds shuffle the cut counts by ``unit_id`` once. Document
frequency is a partial aggregate shuffled by ``idx`` (at most vocabulary-size
rows per task after the map-side combine).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kindred.functions import text as T
from kindred.session import store


def unit_words(units: DataFrame, text_col: str = "text", id_col: str = "unit_id") -> DataFrame:
    """V1 words, one row per occurrence, with the position in the unit."""
    return units.select(F.col(id_col).alias("unit_id"),
                        F.posexplode(T.words(text_col)).alias("pos", "token"))


def term_counts(units: DataFrame, vocab: DataFrame | None = None, text_col: str = "text",
                id_col: str = "unit_id", binary: bool = False) -> DataFrame:
    """V2 / A2: count of each vocabulary word per unit -> ``unit_id, idx, cnt``.

    ``vocab`` is ``name, idx`` of bounded size (a cut vocabulary), broadcast.
    Without ``vocab`` every word counts and the term key is ``token``.
    ``binary`` gives 0-1 cells (P12).
    """
    out = counted(units.select(F.col(id_col).alias("unit_id"), T.words(text_col).alias("__w")), "__w", "token")
    if vocab is not None:
        v = F.broadcast(vocab.select(F.col("name").alias("token"), "idx"))
        out = out.join(v, "token").select("unit_id", "idx", "cnt")
    if binary:
        out = out.withColumn("cnt", F.lit(1).cast("long"))
    return out


def counted(rows: DataFrame, items: str, name: str) -> DataFrame:
    """``unit_id, name, cnt`` of the strings in the array ``items``, per unit.

    The array is sorted and its runs are counted in the row. Counts of an id with
    several rows are added up; which ids these are is asked first, of the ids alone.
    """
    again = rows.groupBy("unit_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("unit_id")
    places = F.when(F.size("__s") > 0, F.sequence(F.lit(0), F.size("__s") - 1))
    # outer, so that no filter on the runs is pushed below the sorted array, which would be sorted for each word
    runs = rows.select("unit_id", F.sort_array(items).alias("__s")) \
        .withColumn("__at", F.filter(places, lambda i: (i == 0) | (F.get("__s", i) != F.get("__s", i - 1)))) \
        .select("unit_id", F.inline_outer(F.transform("__at", lambda at, k: F.struct(
            F.get("__s", at).alias(name),
            (F.coalesce(F.get("__at", k + 1), F.size("__s")) - at).cast("long").alias("cnt"))))).where("cnt IS NOT NULL")
    if again.isEmpty():
        return runs
    again = store(again.select(F.col("unit_id").alias("__u")))
    same = F.col("unit_id").eqNullSafe(F.col("__u"))
    return runs.join(again, same, "left_anti").unionByName(
        runs.join(again, same, "left_semi").groupBy("unit_id", name).agg(F.sum("cnt").alias("cnt")))


def ngram_counts(units: DataFrame, n: int = 2, text_col: str = "text",
                 id_col: str = "unit_id") -> DataFrame:
    """V4: counts of 1..n-grams (tokens joined by one space) per unit."""
    w = T.words(text_col)
    grams = [w]
    for k in range(2, n + 1):
        # k-gram at i joins w[i..i+k-1]
        grams.append(F.expr(
            f"CASE WHEN size(__w) >= {k} THEN transform(sequence(1, size(__w) - {k - 1}), "
            f"i -> array_join(slice(__w, i, {k}), ' ')) ELSE array() END"))
    base = units.select(F.col(id_col).alias("unit_id"), w.alias("__w"))
    cols = [F.col("__w")] + [g for g in grams[1:]]
    return counted(base.select("unit_id", F.flatten(F.array(*cols)).alias("__g")), "__g", "gram")


def term_totals(counts: DataFrame, key: str = "idx") -> DataFrame:
    """A3: total count of each term over all units."""
    return counts.groupBy(key).agg(F.sum("cnt").cast("long").alias("total"))


def document_frequency(counts: DataFrame, key: str = "idx") -> DataFrame:
    """A4: number of units holding each term (counts has one row per unit,term)."""
    return counts.groupBy(key).agg(F.count(F.lit(1)).alias("df"))


def unit_count(counts: DataFrame) -> int:
    """A5: number of units with at least one term (driver scalar)."""
    return counts.select(F.countDistinct("unit_id").alias("n")).first()["n"]


def idf_factor(df_col, n_units) -> F.Column:
    """Smooth IDF with the +1 of the reference: ``1 + ln((N+1)/(1+df))``."""
    return F.lit(1.0) + F.log((F.lit(float(n_units)) + 1.0) / (F.col(df_col) + 1.0))


def tfidf(counts: DataFrame, df: DataFrame | None = None, n_units: int | None = None,
          normalize: bool = True, key: str = "idx") -> DataFrame:
    """V5: ``tf = cnt / sum(cnt)``, ``w = tf * (1 + ln((N+1)/(1+df)))``, then L2.

    ``df`` / ``n_units`` default to those of ``counts``; pass the global ones when
    ``counts`` is a sample (A4/A5 stay global). ``df`` has one row per term, so
    broadcasting it is bounded by the vocabulary size.
    """
    if df is None:
        df = document_frequency(counts, key)
    if n_units is None:
        n_units = unit_count(counts)
    per_unit = Window.partitionBy("unit_id")
    x = (counts.join(F.broadcast(df.select(key, "df")), key)
         .withColumn("tf", F.col("cnt") / F.sum("cnt").over(per_unit))
         .withColumn("w", F.col("tf") * idf_factor("df", n_units)))
    if normalize:
        x = x.withColumn("w", F.col("w") / F.sqrt(F.sum(F.col("w") * F.col("w")).over(per_unit)))
    return x.select("unit_id", key, "w")


def row_norms(weights: DataFrame, value: str = "w") -> DataFrame:
    """L1 sum and L2 norm per unit."""
    return weights.groupBy("unit_id").agg(
        F.sum(value).alias("l1"), F.sqrt(F.sum(F.col(value) * F.col(value))).alias("l2"))


def sparse_vectors(weights: DataFrame, key: str = "idx", value: str = "w") -> DataFrame:
    """Per unit ``vec map<idx, w>`` (bounded by the vocabulary size)."""
    return weights.groupBy("unit_id").agg(
        F.map_from_entries(F.collect_list(F.struct(F.col(key), F.col(value)))).alias("vec"))


def has_vocabulary_word(units: DataFrame, vocab: DataFrame, text_col: str = "text",
                        id_col: str = "unit_id") -> DataFrame:
    """Units with at least one vocabulary word (left semi join)."""
    words = units.select(F.col(id_col).alias("__id"),
                         F.explode(T.words(text_col)).alias("__tok"))
    hit = words.join(F.broadcast(vocab.select(F.col("name").alias("__tok"))), "__tok") \
        .select("__id")
    return units.join(hit, units[id_col] == hit["__id"], "left_semi")


def min_size(units: DataFrame, min_lines: int, text_col: str = "text",
             mode: str = "lines") -> DataFrame:
    """Keep units of at least ``min_lines`` source lines (empty text = 1).

    ``-1`` keeps all, below ``-1`` keeps none (as the reference's test reads).
    ``mode='tokens'`` counts V1 words instead of lines.
    """
    if min_lines == -1:
        return units
    if min_lines < -1:
        return units.where(F.lit(False))
    if mode == "tokens":
        size = F.size(T.words(text_col))
    else:
        size = F.greatest(F.size(F.split(F.col(text_col), "\n")), F.lit(1))
    return units.where(size >= min_lines)
