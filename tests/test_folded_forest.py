"""Components of close sparse vectors by folded screens; reclustering by components; edges found once."""
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from kindred.operators import components as C
from kindred.operators import linkage as LK
from kindred.operators import pairs as N
from kindred.operators import vectorize as V
from kindred.plans import queries as Q


def _rows(n=150, dim=60, seed=3):
    rng = np.random.default_rng(seed)
    X = np.zeros((n, dim))
    for u in range(n):
        k = rng.choice(dim, rng.integers(1, 9), replace=False)
        X[u, k] = rng.random(len(k)) + 0.05
    X[n // 2:n // 2 + 20] = X[:20] * (1 + 0.3 * rng.random((20, dim)))  # near copies
    return X


def _side(X, ids, rows):
    frame = pd.DataFrame({"id": ids, "k": [np.flatnonzero(x).astype(np.int32) for x in X], "v": [x[x != 0] for x in X]})
    return N._Side([N._packed(frame[s:s + 40]) for s in range(0, len(X), 40)], rows, X.shape[1], "cosine")


def _labels(ids, X, t):
    n = X / np.linalg.norm(X, axis=1)[:, None]
    comp = np.arange(len(X))
    for i, j in zip(*np.nonzero(1 - n @ n.T < t)):
        comp[comp == comp[max(i, j)]] = comp[min(i, j)]
    return pd.Series(ids).groupby(comp).transform("min").to_numpy()


@pytest.mark.parametrize("fold", [12, 512])
@pytest.mark.parametrize("t", [0.1, 0.25, 0.4])
def test_labels_equal_brute_force(monkeypatch, t, fold):
    monkeypatch.setattr(N, "FOLD", fold)
    monkeypatch.setattr(N, "FOLD_HELD", 3)
    monkeypatch.setattr(N, "FOLD_CHUNK", 5)
    X, ids = _rows(), np.arange(150) + 1000
    want = dict(zip(ids, _labels(ids, X, t)))
    one = _side(X, ids, 16)
    order = one.ids.copy()
    got = pd.Series(order).groupby(N._cosine_labels(one, one, True, t)).transform("min")
    assert dict(zip(order, got)) == want and 1 < len(set(want.values())) < 150
    # two groups: only pairs across them are looked at
    a, b = _side(X[:70], ids[:70], 16), _side(X[70:], ids[70:], 16)
    order = np.concatenate([a.ids, b.ids])
    across = pd.Series(order).groupby(N._cosine_labels(a, b, False, t)).transform("min")
    n = X / np.linalg.norm(X, axis=1)[:, None]
    D = 1 - n @ n.T
    D[:70, :70] = D[70:, 70:] = 1.0
    comp = np.arange(150)
    for i, j in zip(*np.nonzero(D < t)):
        comp[comp == comp[max(i, j)]] = comp[min(i, j)]
    assert dict(zip(order, across)) == dict(zip(ids, pd.Series(ids).groupby(comp).transform("min")))


def test_folded_products_are_never_smaller():
    X = _rows()
    s = _side(X, np.arange(150), 64)
    f = N._Folded(s, np.arange(60) % 7)
    for n, rows in enumerate(f.tiles):
        true = f.dense(n) @ f.dense(n).T
        assert (f.folded(n) @ f.folded(n).T >= true - 1e-6).all() and len(rows)


def test_edges_are_found_once(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3), (7, 8), (9, 9)], "i long, j long")
    seen = spark.sparkContext.accumulator(0)

    def count(frames):
        for f in frames:
            seen.add(len(f))
            yield f
    got = C.connected_components(edges.mapInPandas(count, "i long, j long"), edges.select(F.col("i").alias("unit_id")))
    assert {(r.unit_id, r.component) for r in got.collect()} == {(1, 1), (2, 1), (7, 7), (9, 9)}
    assert seen.value == 4


def test_a_parent_above_one_matrix_is_reclustered(spark):
    X = _rows()
    cells = [(int(u), int(k), float(X[u, k])) for u, k in zip(*np.nonzero(X))]
    w = spark.createDataFrame(cells, "unit_id long, idx int, w double")
    w = w.join(w.groupBy("unit_id").agg(F.sqrt(F.sum(F.col("w") ** 2)).alias("n")), "unit_id").select("unit_id", "idx", (F.col("w") / F.col("n")).alias("w")).cache()
    kept = spark.range(150).select(F.col("id").alias("unit_id"), F.lit(0).cast("long").alias("parent_cluster"))
    got = Q.recluster_units(kept, w, 0.10, 60, limit=30)  # 150 members in one parent
    whole = LK.cluster_groups(kept.join(V.sparse_vectors(w).withColumnRenamed("vec", "v"), "unit_id"), "parent_cluster", 0.10,
                              "average", "cosine", "sparse", "unit_id", "v")
    assert got.columns == whole.columns and got.dtypes == whole.dtypes
    assert sorted(got.collect()) == sorted(whole.collect()) and got.where("cluster_size > 1").count() > 0
