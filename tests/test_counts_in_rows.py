"""Counts made inside each row, and dense rows of sparse cells, against plain Python."""

from collections import Counter

from kindred.functions import text as T
from kindred.operators import classify as CL
from kindred.operators import vectorize as V
from pyspark.sql import functions as F

ROWS = [(1, "aa bb aa cc"), (2, None), (3, ""), (4, "x y"), (5, "zz zz zz"), (5, "zz yy"), (None, "aa"), (None, "aa bb"),
        (6, "Éa éa EA ea_1 aa"), (7, " ".join(f"w{i % 7}" for i in range(500)))]


def _expected(words, n):
    out = Counter()
    for unit, ws in words:
        for k in range(1, n + 1):
            out.update((unit, " ".join(ws[i:i + k])) for i in range(len(ws) - k + 1))
    return {(u, g, c) for (u, g), c in out.items()}


def test_counts_with_repeated_and_null_ids(spark):
    df = spark.createDataFrame(ROWS, "unit_id long, text string")
    words = [(r.unit_id, r.w) for r in df.select("unit_id", T.words("text").alias("w")).collect() if r.w]
    assert {tuple(r) for r in V.term_counts(df).collect()} == _expected(words, 1)
    assert {tuple(r) for r in V.ngram_counts(df, 2).collect()} == _expected(words, 2)
    voc = spark.createDataFrame([("aa", 0), ("zz", 1), ("w3", 2)], "name string, idx int")
    want = {(u, {"aa": 0, "zz": 1, "w3": 2}[g], c) for u, g, c in _expected(words, 1) if g in ("aa", "zz", "w3")}
    assert {tuple(r) for r in V.term_counts(df, voc).collect()} == want
    assert V.term_counts(df.limit(0)).count() == 0


def test_counts_of_single_rows_are_not_shuffled(spark):
    df = spark.createDataFrame([r for r in ROWS if r[0] not in (None, 5)], "unit_id long, text string")
    for counted in (V.term_counts(df), V.ngram_counts(df, 2)):
        plan = counted._jdf.queryExecution().toString()
        assert "Exchange" not in plan and "Aggregate" not in plan


def test_dense_rows_cost_their_dimension(spark):
    cells = [(1, 0, 2.0), (1, 4, 1.5), (2, 2, 1.0), (3, 5, 3.0), (4, 9, 1.0), (4, 1, 7.0), (5, 3, None)]
    df = spark.createDataFrame(cells, "unit_id long, idx int, w double")
    dense = CL.dense_from_sparse(df, 6)
    got = {r.unit_id: r.features.toArray().tolist() for r in dense.collect()}
    assert got == {1: [2, 0, 0, 0, 1.5, 0], 2: [0, 0, 1, 0, 0, 0], 3: [0, 0, 0, 0, 0, 3], 4: [0, 7, 0, 0, 0, 0], 5: [0] * 6}
    assert "element_at" not in dense._jdf.queryExecution().toString()  # a look-up per dimension reads all cells
    assert CL.dense_from_sparse(df.where(F.lit(False)), 6).count() == 0
