"""Distributed scans against pandas/numpy on skewed input (one part holds
most rows and spans many partitions)."""

import numpy as np
import pandas as pd

from pyspark.sql import functions as F

from kindred.functions.rank import global_row_number, running_sums
from kindred.operators.sampling import top_n_per_group
from kindred.operators.stats import group_quantile


def _skewed(spark, n=3000, seed=0):
    rng = np.random.default_rng(seed)
    part = np.where(rng.random(n) < 0.7, 0, rng.integers(1, 20, n))
    pdf = pd.DataFrame({"part": part.astype(np.int64), "pos": rng.permutation(n).astype(np.int64),
                        "v": rng.integers(0, 5, n).astype(np.int64)})
    return pdf, spark.createDataFrame(pdf).repartition(13)


def test_running_sums_match_cumsum(spark):
    pdf, df = _skewed(spark)
    got = running_sums(df, "part", "pos", {"cum": F.col("v"), "rk": F.lit(1)}).toPandas()
    want = pdf.sort_values(["part", "pos"]).assign(
        cum=lambda d: d.groupby("part")["v"].cumsum(), rk=lambda d: d.groupby("part").cumcount() + 1)
    m = want.merge(got, on=["part", "pos"], suffixes=("", "_g"))
    assert len(m) == len(pdf)
    assert (m["cum"] == m["cum_g"]).all() and (m["rk"] == m["rk_g"]).all()


def test_global_row_number_is_a_permutation(spark):
    pdf, df = _skewed(spark)
    got = global_row_number(df, F.asc("part"), F.asc("pos"), name="r").toPandas()
    want = pdf.sort_values(["part", "pos"]).reset_index(drop=True)
    want["r"] = np.arange(1, len(want) + 1)
    m = want.merge(got, on=["part", "pos"], suffixes=("", "_g"))
    assert (m["r"] == m["r_g"]).all()


def test_top_n_per_group_and_group_quantile(spark):
    pdf, df = _skewed(spark)
    got = top_n_per_group(df, "part", [F.desc("pos")], 3).toPandas()
    want = pdf.sort_values("pos", ascending=False).groupby("part").head(3)
    assert sorted(map(tuple, got[["part", "pos"]].values)) == sorted(map(tuple, want[["part", "pos"]].values))
    q = {r.part: r["__q"] for r in group_quantile(df, "part", "pos", 0.37).collect()}
    for p, g in pdf.groupby("part"):
        assert abs(q[p] - float(np.percentile(g["pos"].to_numpy(), 37))) < 1e-9
