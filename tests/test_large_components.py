"""Components above one task's matrix: merged in rounds, against the matrix of each component."""

import numpy as np
import pytest

from kindred.operators import components as C
from kindred.operators import linkage as LK
from kindred.operators import pairs as N


def _vectors(spark, copies=True):
    rng = np.random.default_rng(8)
    X = np.vstack([rng.normal(c, 0.5, size=(60, 6)) for c in rng.normal(0, 1, size=(5, 6))])
    if copies:
        X[40:60] = X[3]
        X[100] = X[3]
    return spark.createDataFrame([(7 * i + 1, X[i].tolist()) for i in range(len(X))], "unit_id long, v array<double>")


@pytest.mark.parametrize("method,metric,t", [("average", "cosine", 0.5), ("weighted", "cosine", 0.5), ("complete", "cosine", 0.6),
                                             ("single", "cosine", 0.1), ("ward", "euclidean", 1.5)])
@pytest.mark.parametrize("limit", [150])
def test_rounds_equal_one_matrix(spark, monkeypatch, method, metric, t, limit):
    monkeypatch.setattr(LK, "_TILE", 16)
    v = _vectors(spark, copies=method != "weighted")  # halves of copies in another order weigh the same, but round otherwise
    pairs = N.dense_pairs(v, metric, t, id_col="unit_id", vec_col="v", forest=True)
    got, want = ({r.unit_id: tuple(r) for r in LK.linkage_clusters(v, pairs, t, method, metric, "dense", "unit_id", "v",
                                                                   max_component=n).collect()} for n in (limit, 5000))
    assert max(r[4] for r in want.values()) > 5
    assert {u: (r[1], r[2], r[4]) for u, r in got.items()} == {u: (r[1], r[2], r[4]) for u, r in want.items()}
    if method == "weighted":  # no equal heights: the order in a cluster is the same, too
        assert got == want


def test_merge_tables_are_the_same(spark, monkeypatch):
    monkeypatch.setattr(LK, "_TILE", 16)
    v = _vectors(spark, copies=False)
    pairs = N.dense_pairs(v, "cosine", 0.5, id_col="unit_id", vec_col="v", forest=True)
    comp = C.connected_components(pairs, v.select("unit_id"))

    def table(limit):
        rows = LK.component_merges(v, comp, 0.5, max_component=limit).collect()
        return sorted((r.component, r.step, r.left, r.right, round(r.height, 9), r.size) for r in rows)
    want = table(5000)
    assert len(want) > 200 and table(200) == want


def test_ids_that_come_twice(spark):
    v = _vectors(spark, copies=False)
    v = v.unionByName(v.where("unit_id < 100"))
    pairs = N.dense_pairs(v, "cosine", 0.5, id_col="unit_id", vec_col="v", forest=True)
    got, want = (sorted(tuple(r)[:3] + (r.cluster_size,) for r in LK.linkage_clusters(
        v, pairs, 0.5, max_component=n).collect()) for n in (200, 5000))
    assert got == want
