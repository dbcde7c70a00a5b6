"""Confusion reports (FIXTURES.md section 7) and vector statistics."""

import numpy as np
from pyspark.sql import functions as F

from kindred.operators import evaluate as EV
from kindred.operators import stats as SS


def _conf(spark):
    return spark.createDataFrame([(0, 0, 5), (0, 1, 1), (1, 0, 2), (1, 1, 2)],
                                 "label int, prediction int, n long")


def test_confusion_reports(spark):
    conf = _conf(spark)
    assert abs(EV.accuracy(conf).first().accuracy - 0.7) < 1e-12
    rep = {r["class"]: r for r in EV.class_report(conf).collect()}
    assert abs(rep[0].precision - 5 / 7) < 1e-12 and abs(rep[0].recall - 5 / 6) < 1e-12
    assert abs(rep[1].precision - 2 / 3) < 1e-12 and abs(rep[1].recall - 0.5) < 1e-12
    mc = {r["class"]: r for r in EV.most_confused(conf).collect()}
    assert mc[0].by_recall == "1_0.1667" and mc[0].by_precision == "1_0.2857"


def test_class_distance_cosine_equals_pairs(spark):
    rng = np.random.default_rng(0)
    X = rng.random((40, 5))
    g = np.arange(40) % 3
    c = (np.arange(40) // 3) % 2
    df = spark.createDataFrame([(i, X[i].tolist(), int(g[i]), int(c[i])) for i in range(40)],
                               "vec_id long, embedding array<double>, g int, c int")
    got = {(r.g, r.c): r.dist for r in SS.class_distance_cosine(df, "g", "c").collect()}
    got_b = {(r.g, r.c): r.dist for r in SS.class_distance_blocked(df, "g", "c", metric="cosine",
                                                                   block_rows=4).collect()}
    U = X / np.linalg.norm(X, axis=1)[:, None]
    for (gg, cc), d in got.items():
        a = U[g == gg]
        b = U[(g == gg) & (c == cc)]
        want = float((1 - a @ b.T).mean())
        assert abs(d - want) < 1e-9 and abs(got_b[(gg, cc)] - want) < 1e-9


def test_exact_quantile(spark):
    vals = [float(x) for x in np.random.default_rng(1).random(101)]
    df = spark.createDataFrame([(v,) for v in vals], "x double").repartition(5)
    assert abs(SS.exact_quantile(df, "x", 0.8) - float(np.percentile(vals, 80))) < 1e-12
    cls = SS.percentile_classes(df, "x", 0.8).agg(F.sum("class")).first()[0]
    assert cls == 81
