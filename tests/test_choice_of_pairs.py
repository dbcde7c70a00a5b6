"""The estimate that chooses the strategy counts postings inside rows and shuffles no cells."""

import numpy as np
from pyspark.sql import functions as F

from kindred.operators import pairs as N
from kindred.operators import vectorize as V


def test_postings_of_rows_equal_those_of_windows(spark, monkeypatch):
    rng = np.random.default_rng(5)
    rows = [(u, int(k), int(rng.integers(1, 4))) for u in range(90) for k in rng.choice(40, rng.integers(1, 9), replace=False)]
    w = V.tfidf(spark.createDataFrame(rows, "unit_id long, idx int, cnt long")).cache()
    df = V.document_frequency(w)
    lists = N._prefix_terms(w, df, 0.6, "idx").groupBy("idx").count()
    want = lists.agg(F.sum(F.col("count") * (F.col("count") - 1) / 2)).first()[0]
    vec = V.sparse_vectors(w)
    assert N._posting_pairs(vec, df, 0.6, 40) == want > 0

    def pairs():
        return sorted((r.i, r.j, round(r.dist, 9)) for r in N.cosine_within(w, 0.4, dim=40).collect())
    blocks = pairs()
    monkeypatch.setattr(N, "BLOCKS_CHEAP_FLOPS", 0)
    monkeypatch.setattr(N, "ROW_OP_FLOPS", 1e-9)  # the prefix join is the cheaper one
    assert pairs() == blocks and len(blocks) > 0
    monkeypatch.setattr(N, "ROW_OP_FLOPS", 1e9)
    monkeypatch.setattr(N, "_prefix_terms", None)  # not asked where blocks are chosen
    assert pairs() == blocks
