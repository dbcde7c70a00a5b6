"""Pairs, components and linkage against brute force (FIXTURES.md section 6)."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from kindred.operators import components as C
from kindred.operators import linkage as LK
from kindred.operators import pairs as N
from kindred.operators import vectorize as V


def _random_counts(spark, n=150, d=40, seed=0):
    rng = np.random.default_rng(seed)
    base = rng.integers(0, 3, size=(8, d))
    rows = []
    for u in range(n):
        v = base[u % 8] + rng.integers(0, 2, size=d) * (rng.random(d) < 0.3)
        for i in np.nonzero(v)[0]:
            rows.append((u, int(i), int(v[i])))
    return spark.createDataFrame(rows, "unit_id long, idx int, cnt long")


def _dense(weights, n, d):
    X = np.zeros((n, d))
    for r in weights.collect():
        X[r.unit_id, r.idx] = r.w
    return X


@pytest.mark.parametrize("strategy", ["prefix", "blocks"])
def test_cosine_within_matches_brute_force(spark, strategy):
    counts = _random_counts(spark)
    w = V.tfidf(counts)
    X = _dense(w, 150, 40)
    S = X @ X.T
    t = 0.3
    want = {(i, j) for i in range(150) for j in range(i + 1, 150) if 1 - S[i, j] < t}
    got = N.cosine_within(w, t, strategy=strategy, dim=40, block_rows=37).collect()
    assert {(r.i, r.j) for r in got} == want
    for r in got:
        assert abs(r.dist - (1 - S[r.i, r.j])) < 1e-9


@pytest.mark.parametrize("strategy", ["prefix", "blocks"])
def test_jaccard_within_matches_brute_force(spark, strategy):
    counts = _random_counts(spark, seed=1)
    sets = {}
    for r in counts.collect():
        sets.setdefault(r.unit_id, set()).add(r.idx)
    t = 0.4
    want = set()
    for i in sets:
        for j in sets:
            if i < j and 1 - len(sets[i] & sets[j]) / len(sets[i] | sets[j]) < t:
                want.add((i, j))
    got = {(r.i, r.j) for r in N.jaccard_within(counts, t, strategy=strategy, dim=40,
                                                 block_rows=37).collect()}
    assert got == want


def test_dense_pairs_nearest_and_knn(spark):
    rng = np.random.default_rng(5)
    X = rng.normal(size=(90, 6))
    df = spark.createDataFrame([(i, X[i].tolist()) for i in range(90)], "vec_id long, embedding array<double>")
    D = np.sqrt(((X[:, None, :] - X[None, :, :]) ** 2).sum(2))
    t = 2.0
    want = {(i, j) for i in range(90) for j in range(i + 1, 90) if D[i, j] < t}
    got = {(r.i, r.j) for r in N.dense_pairs(df, "euclidean", t, block_rows=25).collect()}
    assert got == want
    nn = {r.i: r.j for r in N.nearest(df, "euclidean", block_rows=25).collect()}
    Dn = D + np.diag([np.inf] * 90)
    assert nn == {i: int(np.argmin(Dn[i])) for i in range(90)}
    q = df.where("vec_id < 30")
    ref = df.where("vec_id >= 30")
    kn = N.cross_nearest(q, ref, k=3, metric="euclidean", block_rows=20).collect()
    for i in range(30):
        want3 = list(30 + np.argsort(D[i, 30:])[:3])
        got3 = [r.j for r in sorted((r for r in kn if r.i == i), key=lambda r: r.rank)]
        assert got3 == want3


def test_components_match_union_find(spark):
    rng = np.random.default_rng(2)
    edges = [(int(a), int(b)) for a, b in rng.integers(0, 300, size=(260, 2)) if a != b]
    parent = list(range(300))

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x
    for a, b in edges:
        ra, rb = find(a), find(b)
        parent[max(ra, rb)] = min(ra, rb)
    groups = {}
    for v in range(300):
        groups.setdefault(find(v), []).append(v)
    want = {v: min(g) for g in groups.values() for v in g}
    e = spark.createDataFrame(edges, "i long, j long")
    nodes = spark.range(300).withColumnRenamed("id", "unit_id")
    got = {r.unit_id: r.component for r in C.connected_components(e, nodes).collect()}
    assert got == want


TOY = np.array([[0, 1, 3, 3, 3, 4],
                [1, 0, 4, 2, 3, 2],
                [3, 4, 0, 3, 2, 5],
                [3, 2, 3, 0, 2, 4],
                [3, 3, 2, 2, 0, 5],
                [4, 2, 5, 4, 5, 0]], dtype=float)


@pytest.mark.parametrize("method,heights", [
    ("single", [1, 2, 2, 2, 2]),
    ("complete", [1, 2, 3, 4, 5]),
    ("average", [1, 2, 2.5, 3, 4]),
    ("weighted", [1, 2, 2.5, 2.875, 4.25]),
])
def test_toy_linkage_heights(method, heights):
    merges = LK.lance_williams(TOY, method)
    assert [round(h, 6) for _, _, h, _ in merges] == heights
    root, _ = LK.cut_and_order(6, merges, 2.0)
    assert root[0] == root[1] == 0 and len(set(root)) == 5


@pytest.mark.parametrize("method", ["single", "complete", "average", "weighted", "ward"])
def test_component_split_equals_global_cut(method):
    rng = np.random.default_rng(11)
    for _ in range(15):
        X = np.vstack([rng.normal(c, 0.3, size=(8, 2)) for c in rng.normal(0, 3, size=(4, 2))])
        D = np.sqrt(((X[:, None] - X[None]) ** 2).sum(2))
        t = 1.0
        g_root, _ = LK.cut_and_order(len(X), LK.lance_williams(D, method), t)
        # components of {d < t}, then per-component linkage
        comp = list(range(len(X)))
        for i in range(len(X)):
            for j in range(len(X)):
                if D[i, j] < t:
                    a, b = comp[i], comp[j]
                    comp = [min(a, b) if c in (a, b) else c for c in comp]
        local = [None] * len(X)
        for c in set(comp):
            idx = [i for i in range(len(X)) if comp[i] == c]
            r, _ = LK.cut_and_order(len(idx), LK.lance_williams(D[np.ix_(idx, idx)], method), t)
            for k, i in enumerate(idx):
                local[i] = idx[r[k]]
        assert local == g_root


def test_linkage_clusters_distributed(spark):
    rng = np.random.default_rng(4)
    X = np.vstack([rng.normal(c, 0.2, size=(10, 3)) for c in [(0, 0, 0), (5, 5, 5), (9, 0, 0)]])
    v = spark.createDataFrame([(i, X[i].tolist()) for i in range(30)], "unit_id long, v array<double>")
    pairs = N.dense_pairs(v, "euclidean", 1.5, id_col="unit_id", vec_col="v", forest=True, block_rows=8)
    got = LK.linkage_clusters(v, pairs, 1.5, "average", "euclidean", "dense", "unit_id", "v").collect()
    assert sorted({r.cluster_id for r in got}) == [0, 10, 20]
    with pytest.raises(ValueError):
        LK.linkage_clusters(v, pairs, 1.5, "average", "euclidean", "dense", "unit_id", "v",
                            max_component=5)
