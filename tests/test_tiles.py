"""The blocked pair step: groups of tiles, its bounds and its forests, against brute force."""

import numpy as np
import pytest

from kindred.operators import components as C
from kindred.operators import pairs as N


def _sparse(spark, seed, n=120, d=60, binary=False):
    """Two vocabularies that share a few words, sets of very different sizes, exact copies."""
    rng = np.random.default_rng(seed)
    X = np.zeros((n, d))
    for u in range(n):
        half = rng.permutation(np.r_[0:35] if u % 2 else np.r_[30:d])[:rng.integers(1, 30)]
        X[u, half] = 1.0 if binary else rng.random(len(half)) + 0.1
    X[1::10] = X[3]
    X[2::9, 5:] = X[4, 5:]
    X[(X != 0).sum(1) == 0, 0] = 1.0
    rows = [(u, {int(k): float(X[u, k]) for k in np.nonzero(X[u])[0]}) for u in range(n)]
    return X, spark.createDataFrame(rows, "unit_id long, vec map<int,double>")


def _brute(X, metric):
    D = N._dist_matrix(X, X, metric)
    return lambda t: {(i, j) for i in range(len(X)) for j in range(i + 1, len(X)) if D[i, j] < t}


def test_vectors_are_sent_to_few_groups(spark, monkeypatch):
    seen = []
    send = N._block_input
    monkeypatch.setattr(N, "_block_input", lambda v, i, c, nb, kind="dense": seen.append(nb) or send(v, i, c, nb, kind))
    X = np.random.default_rng(0).normal(size=(640, 4))
    df = spark.createDataFrame([(i, X[i].tolist()) for i in range(640)], "vec_id long, embedding array<double>")
    got = {(r.i, r.j) for r in N.dense_pairs(df, "euclidean", 0.5, block_rows=8).collect()}
    D = np.sqrt(((X[:, None] - X[None]) ** 2).sum(2))
    assert got == {(int(i), int(j)) for i, j in zip(*np.nonzero(D < 0.5)) if i < j}
    assert seen[0] <= 640 // (8 * N.GROUP_TILES) + 1


@pytest.mark.parametrize("metric,t", [("cosine", 0.4), ("cosine", 0.05), ("jaccard_set", 0.5), ("jaccard_set", 0.9)])
def test_sparse_tiles_and_forests_match_brute_force(spark, metric, t):
    X, df = _sparse(spark, 3, binary=metric == "jaccard_set")
    want = _brute(X, metric)(t)
    args = dict(id_col="unit_id", vec_col="vec", block_rows=11, kind="sparse", dim=60)
    got = [(r.i, r.j) for r in N.dense_pairs(df, metric, t, **args).collect()]
    assert len(got) == len(set(got)) and set(got) == want
    comp = {}
    for name, edges in (("forest", N.dense_pairs(df, metric, t, forest=True, **args)),
                        ("pairs", spark.createDataFrame([*want] or [(0, 0)], "i long, j long"))):
        rows = C.connected_components(edges, df.select("unit_id")).collect()
        comp[name] = {r.unit_id: r.component for r in rows}
    assert comp["forest"] == comp["pairs"]


def test_user_metric_is_scored_where_the_pair_is_found(spark):
    X = np.random.default_rng(1).normal(size=(60, 5))
    rows = [(i, X[i].tolist()) for i in range(60)] + [(7, X[8].tolist()), (9, X[9].tolist())]  # ids that come twice
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")

    def signed(A, B):
        return (A - 2 * B).sum(axis=1)

    def table(d):
        return sorted((r.i, r.j, round(r.dist, 9)) for r in d.collect())
    new = N.user_metric_pairs(None, df, signed, within=("cosine", 0.6))
    assert table(new) == table(N.user_metric_pairs(N.dense_pairs(df, "cosine", 0.6), df, signed))
    assert "Join" not in new._jdf.queryExecution().toString()
    with pytest.raises(ValueError):
        N.user_metric_pairs(None, df, signed)


def test_rounding_near_the_threshold_is_decided_in_float64():
    rng = np.random.default_rng(2)
    X = rng.random((40, 30))
    D = N._dist_matrix(X, X, "cosine")
    for t in np.sort(D[np.triu_indices(40, 1)])[::97]:  # the threshold is a distance itself
        lab = np.arange(40)
        x = N._Rows(X, "cosine")
        cells = {(int(a), int(b)) for r, c in N._forest_cells(x, x, lab, lab, lab, lab, "cosine", float(t) + 1e-12, True)
                 for a, b in zip(r, c)}
        assert cells == {(i, j) for i in range(40) for j in range(40) if i != j and D[i, j] < t + 1e-12}


def test_sparse_groups_grow_with_their_cells_only():
    """1 GB of documents: 512,820 rows of 77 cells went to 32 groups each."""
    assert N._n_groups(512_820, 1024, 12, 512_820 * 77) == 7
    assert N._n_groups(3_000_000, 1024, 12, 3_000_000 * 77) < 20
    assert N._n_groups(100_000, 1024, 12, 100_000 * 2000) == 12  # long rows: by cells


@pytest.mark.parametrize("held", [1, 11 * 60 * 3])
@pytest.mark.parametrize("metric,t", [("cosine", 0.4), ("jaccard_set", 0.5)])
def test_few_tiles_are_held_at_a_time(metric, t, held, monkeypatch):
    monkeypatch.setattr(N, "MAX_HELD_CELLS", held)
    rng = np.random.default_rng(7)
    X = (rng.random((90, 60)) < 0.2) * 1.0
    X[:, 3] = 0
    X[11] = 0  # an empty row
    import pandas as pd
    part = pd.DataFrame({"id": np.arange(90), "k": [np.nonzero(r)[0] for r in X], "v": [r[r != 0] for r in X]})
    side = N._Side([N._packed(part[:40]), N._packed(part[40:])], 11, 60, metric)
    seen = []
    for block in side.blocks():
        for n in block:
            seen.append(n)
            assert (side.rows(n, held=True).X == X[side.ids[side.tiles[n]]]).all()
            assert len(side.held) <= side.hold == max(1, held // 660)
    assert seen == list(range(9))
