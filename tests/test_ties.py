"""Neighbours among exact copies: the smaller id wins, whatever the block."""

import numpy as np
import pytest

from kindred.operators import pairs


@pytest.mark.parametrize("metric", ["cosine", "euclidean"])
def test_nearest_among_copies(spark, metric):
    v = np.random.default_rng(5).standard_normal(24)
    rows = [(i, v.tolist()) for i in range(60)]
    d = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)
    got = {r.i: r.j for r in pairs.nearest(d, metric, block_rows=16).collect()}
    assert got == {i: 0 if i else 1 for i in range(60)}


@pytest.mark.parametrize("dim", [64, 128])
@pytest.mark.parametrize("metric", ["cosine", "euclidean", "sqeuclidean"])
def test_block_keeps_smaller_ids_of_copies_and_near_copies(metric, dim):
    """Matrix products tell copies apart by noise; the cut must not."""
    rng = np.random.default_rng(7)
    X = np.repeat(rng.standard_normal((4, dim)) * 50, 40, axis=0)
    X[::5] += rng.standard_normal(X[::5].shape) * 1e-9  # nearer than the noise
    ids = rng.permutation(len(X))
    X = X[rng.permutation(len(X))]
    r, c, d = pairs._row_best(pairs._dist_matrix(X, X, metric), 5, ids, X, X, metric)
    for q in range(len(X)):
        exact = pairs._exact_rows(np.repeat(X[q:q + 1], len(X), 0), X, metric)
        want = sorted(zip(exact.tolist(), ids.tolist()))[:5]
        assert list(zip(d[r == q].tolist(), ids[c[r == q]].tolist())) == want


def test_cross_nearest_among_copies(spark):
    rng = np.random.default_rng(8)
    v = rng.standard_normal((3, 64))
    refs = spark.createDataFrame([(i, v[i % 3].tolist()) for i in range(90)], "vec_id long, embedding array<double>")
    queries = spark.createDataFrame([(1000 + i, v[i].tolist()) for i in range(3)], refs.schema)
    got = pairs.cross_nearest(queries, refs, 3, block_rows=90).collect()
    assert sorted((r.i, r["rank"], r.j, r.dist) for r in got) == [
        (1000 + i, n + 1, i + 3 * n, 0.0) for i in range(3) for n in range(3)]


def test_cosine_within_keeps_pairs_without_a_shared_term(spark):
    w = spark.createDataFrame([(1, 0, 1.0), (2, 1, 1.0), (3, 0, 1.0)], "unit_id long, idx int, w double")
    got = pairs.cosine_within(w, 1.2, dim=10_000).collect()
    assert sorted((r.i, r.j, r.dist) for r in got) == [(1, 2, 1.0), (1, 3, 0.0), (2, 3, 1.0)]
    with pytest.raises(ValueError):
        pairs.cosine_within(w, 1.0, strategy="prefix")
