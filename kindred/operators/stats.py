"""Vector statistics: A11 (row mean/std, centroids), A13 (percentile classes),
N6 (mean distance of a group to one class), N7 (class separation).

N6 with cosine distance is linear: the mean over ordered pairs of
``1 - x.y/(|x||y|)`` equals ``1 - (sum of unit x) . (sum of unit y) / (n m)``,
so it is a grouped sum, whatever the group size. Euclidean distance has no
such form; it is summed over per-group block pairs (each task holds at most
two blocks of ``block_rows`` vectors), never one group in one task.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kindred.functions.rank import global_row_number
from kindred.operators.pairs import _dist_matrix


def row_mean_std(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """A11 per row: mean and population std of a vector's components."""
    v = F.col(vec_col).cast("array<double>")
    n = F.size(v).cast("double")
    mean = F.aggregate(v, F.lit(0.0), lambda a, x: a + x) / n
    sq = F.aggregate(v, F.lit(0.0), lambda a, x: a + x * x) / n
    return vectors.select(F.col(id_col), mean.alias("mean"),
                          F.sqrt(F.greatest(sq - mean * mean, F.lit(0.0))).alias("std"))


def centroids(vectors: DataFrame, group_col: str, vec_col: str = "embedding") -> DataFrame:
    """A11 per group: component-wise mean and population std (``group, dim, mean, std``)."""
    x = vectors.select(F.col(group_col), F.posexplode(F.col(vec_col).cast("array<double>"))
                       .alias("dim", "x"))
    return x.groupBy(group_col, "dim").agg(F.avg("x").alias("mean"), F.stddev_pop("x").alias("std"))


def row_sums(vectors=None, vec_col: str = "embedding") -> F.Column:
    return F.aggregate(F.col(vec_col).cast("array<double>"), F.lit(0.0), lambda a, x: a + x)


def percentile_classes(df: DataFrame, value_col: str, p: float, group_col: str | None = None) -> DataFrame:
    """Class 0 when the value is above the (linearly interpolated)
    ``p``-quantile of its group, else 1. Without a group the quantile is exact
    over all rows via a distributed rank (no one-task buffer)."""
    if group_col is not None:
        x = df.join(group_quantile(df, group_col, value_col, p), group_col)
    else:
        q = exact_quantile(df, value_col, p)
        x = df.withColumn("__q", F.lit(q))
    return x.withColumn("class", F.when(F.col(value_col) > F.col("__q"), 0).otherwise(1)).drop("__q")


def group_quantile(df: DataFrame, group_col: str, value_col: str, p: float) -> DataFrame:
    """``group, __q``: the linear-interpolation ``p``-quantile of each group,
    from distributed ranks inside the group (no one-task value buffer)."""
    from kindred.functions.rank import running_sums
    v = df.select(F.col(group_col), F.col(value_col).cast("double").alias("__v")) \
        .where(F.col("__v").isNotNull())
    ranked = running_sums(v, group_col, "__v", {"__r": F.lit(1)})  # ties: any order, same values
    n = v.groupBy(group_col).agg(F.count(F.lit(1)).alias("__n"))
    pos = F.lit(p) * (F.col("__n") - 1)
    want = n.select(group_col, pos.alias("__pos"), (F.floor(pos) + 1).alias("__lo"),
                    (F.ceil(pos) + 1).alias("__hi"))
    at = ranked.join(want, group_col).where((F.col("__r") == F.col("__lo")) | (F.col("__r") == F.col("__hi")))
    q = at.groupBy(group_col, "__pos", "__lo").agg(
        F.max(F.when(F.col("__r") == F.col("__lo"), F.col("__v"))).alias("__a"),
        F.max(F.when(F.col("__r") == F.col("__hi"), F.col("__v"))).alias("__b"))
    return q.select(group_col, (F.col("__a") + (F.col("__b") - F.col("__a"))
                                * (F.col("__pos") - (F.col("__lo") - 1))).alias("__q"))


def exact_quantile(df: DataFrame, value_col: str, p: float) -> float:
    """Linear-interpolation quantile of a column from a global sort + rank."""
    v = df.select(F.col(value_col).cast("double").alias("v")).where(F.col("v").isNotNull())
    ranked = global_row_number(v, F.asc("v"), name="r", start=0)
    n = ranked.count()
    if n == 0:
        return float("nan")
    pos = p * (n - 1)
    lo, hi = math.floor(pos), math.ceil(pos)
    vals = {r["r"]: r["v"] for r in ranked.where(F.col("r").isin(lo, hi)).collect()}
    return vals[lo] + (vals[hi] - vals[lo]) * (pos - lo)


def class_distance_cosine(vectors: DataFrame, group_col: str, class_col: str,
                          vec_col: str = "embedding") -> DataFrame:
    """N6 (cosine): ``group, class, dist`` = mean over (member, class member)
    ordered pairs, self pairs included."""
    v = F.col(vec_col).cast("array<double>")
    norm = F.sqrt(F.aggregate(v, F.lit(0.0), lambda a, x: a + x * x))
    unit = vectors.select(F.col(group_col), F.col(class_col),
                          F.posexplode(F.transform(v, lambda x: x / norm)).alias("dim", "u"))
    all_sum = unit.groupBy(group_col, "dim").agg(F.sum("u").alias("sa"))
    cls_sum = unit.groupBy(group_col, class_col, "dim").agg(F.sum("u").alias("sc"))
    sizes = vectors.groupBy(group_col).agg(F.count(F.lit(1)).alias("n"))
    csize = vectors.groupBy(group_col, class_col).agg(F.count(F.lit(1)).alias("m"))
    dots = cls_sum.join(all_sum, [group_col, "dim"]).groupBy(group_col, class_col) \
        .agg(F.sum(F.col("sa") * F.col("sc")).alias("dot"))
    return dots.join(sizes, group_col).join(csize, [group_col, class_col]).select(
        group_col, class_col, (F.lit(1.0) - F.col("dot") / (F.col("n") * F.col("m"))).alias("dist"))


def class_distance_blocked(vectors: DataFrame, group_col: str, class_col: str,
                           id_col: str = "vec_id", vec_col: str = "embedding",
                           metric: str = "euclidean", block_rows: int = 1024) -> DataFrame:
    """N6 for any metric: sums over per-group block pairs, then the mean."""
    sizes = vectors.groupBy(group_col).agg(F.count(F.lit(1)).alias("n"))
    nb = F.greatest(F.ceil(F.col("n") / F.lit(block_rows)), F.lit(1)).cast("int")
    x = vectors.join(sizes, group_col).select(
        F.col(group_col).cast("long").alias("g"), F.col(class_col).cast("long").alias("c"),
        F.col(id_col).cast("long").alias("id"), F.col(vec_col).cast("array<double>").alias("v"),
        F.pmod(F.xxhash64(F.col(id_col)), nb).cast("int").alias("own"), nb.alias("nb"))
    x = x.withColumn("partner", F.explode(F.sequence(F.lit(0), F.col("nb") - 1)))
    x = x.select("g", F.least("own", "partner").alias("ba"), F.greatest("own", "partner").alias("bb"),
                 "own", "c", "v")

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        ba, bb = int(pdf["ba"].iloc[0]), int(pdf["bb"].iloc[0])
        a = pdf[pdf["own"] == ba]
        b = a if ba == bb else pdf[pdf["own"] == bb]
        A = np.array(a["v"].tolist(), dtype=np.float64).reshape(len(a), -1)
        B = A if ba == bb else np.array(b["v"].tolist(), dtype=np.float64).reshape(len(b), -1)
        D = _dist_matrix(A, B, metric)
        if ba == bb:
            np.fill_diagonal(D, 0.0)
        out = {}
        cb = b["c"].to_numpy()
        for c in np.unique(cb):  # members of a vs class-c members of b
            out[c] = out.get(c, 0.0) + float(D[:, cb == c].sum())
        if ba != bb:
            ca = a["c"].to_numpy()
            for c in np.unique(ca):  # members of b vs class-c members of a
                out[c] = out.get(c, 0.0) + float(D[ca == c, :].sum())
        g = int(pdf["g"].iloc[0])
        return pd.DataFrame({"g": [g] * len(out), "c": list(out), "s": list(out.values())})

    sums = x.groupBy("g", "ba", "bb").applyInPandas(run, "g long, c long, s double") \
        .groupBy("g", "c").agg(F.sum("s").alias("s"))
    csize = vectors.groupBy(F.col(group_col).cast("long").alias("g"),
                            F.col(class_col).cast("long").alias("c")).agg(F.count(F.lit(1)).alias("m"))
    gsize = sizes.select(F.col(group_col).cast("long").alias("g"), "n")
    return sums.join(csize, ["g", "c"]).join(gsize, "g").select(
        F.col("g").alias(group_col), F.col("c").alias(class_col),
        (F.col("s") / F.col("n") / F.col("m")).alias("dist"))


def class_separation(dist: DataFrame, group_col: str, class_col: str = "class",
                     yes=1, no=0) -> DataFrame:
    """N7 per group: ratio yes/no, difference yes-no and whether no < yes."""
    p = dist.groupBy(group_col).agg(
        F.max(F.when(F.col(class_col) == yes, F.col("dist"))).alias("d_yes"),
        F.max(F.when(F.col(class_col) == no, F.col("dist"))).alias("d_no"))
    return p.select(group_col, "d_yes", "d_no",
                    (F.col("d_yes") / F.col("d_no")).alias("ratio"),
                    (F.col("d_yes") - F.col("d_no")).alias("diff"),
                    (F.col("d_no") < F.col("d_yes")).cast("int").alias("no_lt_yes"))


def separation_summary(sep: DataFrame) -> DataFrame:
    """N7 over groups: mean ratio, mean difference, share where no < yes."""
    return sep.agg(F.avg("ratio").alias("avg_ratio"), F.avg("diff").alias("avg_diff"),
                   F.avg("no_lt_yes").alias("share_no_lt_yes"))
