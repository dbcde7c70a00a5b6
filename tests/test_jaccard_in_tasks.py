"""Jaccard pairs scored inside tasks: cells in blocks, buckets as bit sets."""
import numpy as np
import pandas as pd
import pytest

from kindred.operators import pairs as N


def _cells(seed=4, n=70, dim=9):
    rng = np.random.default_rng(seed)
    x = rng.integers(0, 3, (n, dim)) * (rng.random((n, dim)) < 0.7) * 0.5
    x[10:20] = x[0:10]  # copies
    x[20:25, 0] = 9.0   # equal as sets, not in value
    x[25:30] = np.where(x[20:25] != 0, 3.0, 0.0)
    x[30] = 0.0
    return x


@pytest.mark.parametrize("t", [0.2, 0.5, 0.8])
def test_cells_in_blocks_equal_brute_force_and_the_prefix_join(spark, t):
    x = _cells()
    cells = [(i, k, float(x[i, k])) for i in range(len(x)) for k in range(x.shape[1])]
    d = spark.createDataFrame(cells + [(None, 1, 1.0)], "unit_id long, idx int, cnt double").repartition(5)
    want = {}
    for i in range(len(x)):
        for j in range(i + 1, len(x)):
            either = (x[i] != 0) | (x[j] != 0)
            if x[i].any() and x[j].any() and (dist := ((x[i] != x[j]) & either).sum() / either.sum()) < t:
                want[i, j] = dist
    found = N.jaccard_cells_within(d, t, dim=x.shape[1], block_rows=16)
    assert {(r.i, r.j): r.dist for r in found.collect()} == want and want
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan  # no candidates, and no cells for them, are shuffled
    assert sorted(found.collect()) == sorted(N.jaccard_cells_within(d, t).collect())


def test_no_candidates_at_all(spark):
    none = spark.createDataFrame([], "unit_id long, idx int, cnt long")
    assert N.jaccard_cells_within(none, 0.5, dim=10).count() == 0


@pytest.mark.parametrize("most", [8192, 64])  # all terms have a bit; terms share bits
def test_buckets_are_scored_exactly(monkeypatch, most):
    monkeypatch.setattr(N, "MAX_BLOCK_DIM", most)
    monkeypatch.setattr(N, "BUCKET_ROWS", 30)
    monkeypatch.setattr(N, "_SCORED", 7)
    rng = np.random.default_rng(1)
    base = [np.sort(rng.choice(10 ** 9, 12, replace=False)) for _ in range(6)]
    rows = []
    for b in range(5):
        for u in range(14):
            s = base[(b + u) % 6]
            rows.append((f"b{b}", 100 * b + u, -1, np.sort(np.concatenate([s[:8 + u % 5], rng.choice(10 ** 9, u % 4)]))))
    part = pd.DataFrame(rows, columns=["bucket", "unit_id", "own", "a"])
    part.loc[part["bucket"] == "b3", "own"] = part["unit_id"] % 2  # a split bucket: pairs within a half are another group's
    got = pd.concat(N._bucket_pairs(iter([part[k:k + 9] for k in range(0, len(part), 9)]), 0.5))
    want = {}
    for _, x in part.iterrows():
        for _, y in part.iterrows():
            if x.bucket == y.bucket and x.unit_id < y.unit_id and (x.own < 0 or x.own != y.own):
                both = len(set(x.a) & set(y.a))
                d = 1.0 - both / (len(x.a) + len(y.a) - both)
                if d < 0.5:
                    want[x.unit_id, y.unit_id] = d
    assert {(i, j): d for i, j, d in got.itertuples(index=False)} == want and len(got) == len(want) > 20


def test_sets_alone_in_their_buckets_are_not_sent(spark):
    rows = [(u, 1000 * u + k) for u in range(40) for k in range(6)] + [(77, k) for k in range(6)]  # 77 is unit 0's copy
    found = N.jaccard_within_approx(spark.createDataFrame(rows, "unit_id long, idx int"), 0.5)
    assert [tuple(r) for r in found.collect()] == [(0, 77, 0.0)]
    assert "LeftSemi" in found._jdf.queryExecution().optimizedPlan().toString()


def test_ids_that_are_strings(spark):
    rows = [(u, k) for u in "ab" for k in range(9)] + [("c", 50)]
    assert [tuple(r) for r in N.jaccard_within_approx(spark.createDataFrame(rows, "unit_id string, idx int"), 0.5).collect()] \
        == [("a", "b", 0.0)]
