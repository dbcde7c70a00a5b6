"""Jaccard pairs by buckets of minimum hashes against all pairs."""

import numpy as np
import pytest

from kindred.operators import pairs as N


def _sets(n=240, seed=5):
    """Families of sets at all similarities, a group of 60 equal sets among them."""
    rng = np.random.default_rng(seed)
    out = {}
    for u in range(n):
        family = np.random.default_rng(u % 12).choice(4000, 40, replace=False)
        keep = family[rng.random(40) > rng.choice([0.05, 0.15, 0.3])]
        out[u] = set(keep.tolist()) | set(rng.choice(4000, rng.integers(0, 6)).tolist())
    return out | {n + c: set(range(30)) for c in range(60)}


def _exact(sets, t):
    ids, out = sorted(sets), {}
    for x, i in enumerate(ids):
        for j in ids[x + 1:]:
            d = 1 - len(sets[i] & sets[j]) / len(sets[i] | sets[j])
            if d < t:
                out[i, j] = round(d, 9)
    return out


@pytest.fixture(scope="module")
def table(spark):
    rows = [(u, i) for u, s in _sets().items() for i in s]
    return spark.createDataFrame(rows + rows[:50] + [(9999, None)], "unit_id long, idx int").repartition(4)


@pytest.mark.parametrize("t", [0.5, 0.3])
def test_recall_and_exact_distances(table, t):
    want = _exact(_sets(), t)
    got = {(r.i, r.j): round(r.dist, 9) for r in N.jaccard_within_approx(table, t).collect()}
    assert got.items() <= want.items()  # nothing wrong is reported
    assert len(got) >= 0.9 * len(want)


def test_split_buckets_lose_and_repeat_nothing(table):
    whole = sorted(N.jaccard_within_approx(table, 0.5).collect())
    split = sorted(N.jaccard_within_approx(table, 0.5, chunk_rows=7).collect())
    assert split == whole and len({(r.i, r.j) for r in split}) == len(split)
    assert sum(r.i >= 240 for r in split) == 60 * 59 // 2


def test_banding():
    rows, bands = N.banding(0.5, 0.97, 96)
    assert rows * bands <= 96 and 1 - (1 - 0.5 ** rows) ** bands >= 0.97
    with pytest.raises(ValueError):
        N.banding(0.01, 0.97, 96)


def test_empty_and_bad_threshold(spark):
    none = spark.createDataFrame([], "unit_id long, idx int")
    assert N.jaccard_within_approx(none, 0.5).count() == 0
    with pytest.raises(ValueError):
        N.jaccard_within_approx(none, 1.0)


def test_candidates_are_scored_in_their_bucket(table):
    """No pair is joined with its sets afterwards: one join besides that of the chunk numbers."""
    plan = N.jaccard_within_approx(table, 0.5)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join Inner") == 1
