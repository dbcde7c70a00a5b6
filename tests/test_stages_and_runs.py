"""Stored stages, runs over several order columns, units without known words, plans without text shuffles."""

import pytest

from kindred.operators import embed, segment
from kindred.plans import docs, queries, stages
from kindred.plans.docs import Settings
from kindred.session import path_exists


def test_new_units_rebuild_the_vocabulary(spark, tmp_path):
    s = Settings(vocab_min=1)
    old = spark.createDataFrame([(1, "alpha beta"), (2, "beta gamma")], "unit_id long, text string")
    new = spark.createDataFrame([(7, "delta epsilon"), (8, "delta zeta")], "unit_id long, text string")
    stages.run(spark, old, str(tmp_path), s=s)
    got = stages.run(spark, new, str(tmp_path), stages=("vectors",), s=s)
    assert {r.name for r in got["vocab"].collect()} == {"delta", "epsilon", "zeta"}
    assert got["vectors"].count() == 4


def test_only_an_absent_path_counts_as_absent(spark, tmp_path):
    assert path_exists(spark, str(tmp_path)) and not path_exists(spark, str(tmp_path / "none"))
    bad = tmp_path / "model"
    bad.mkdir()
    lists = spark.createDataFrame([(1, ["a", "b"])], "unit_id long, words array<string>")
    with pytest.raises(Exception):  # a stored model that cannot be read is not overwritten
        embed.load_or_train(lists, str(bad), min_count=1)
    assert list(bad.iterdir()) == []


def test_runs_follow_every_order_column(spark):
    rows = [("p", 1, 1, "a"), ("p", 1, 2, "a"), ("p", 2, 1, "b"), ("p", 2, 2, "b")]
    d = spark.createDataFrame(rows, "part string, a int, b int, v string").repartition(3)
    got = [(r.value, r.length) for r in segment.islands(d, "part", ["a", "b"], "v").orderBy("run").collect()]
    assert got == [("a", 2), ("b", 2)]


def test_units_without_known_words_have_the_zero_vector(spark):
    lists = spark.createDataFrame([(1, ["x", "x", "y"]), (2, ["q"]), (3, [])],
                                  "unit_id long, words array<string>")
    vectors = spark.createDataFrame([("x", [1.0, 0.0]), ("y", [4.0, 3.0])], "word string, vector array<double>")
    got = {r.unit_id: r.embedding for r in embed.unit_embedding(lists, vectors).collect()}
    assert got == {1: pytest.approx([2.0, 1.0]), 2: [0.0, 0.0], 3: [0.0, 0.0]}


def test_texts_are_never_shuffled(spark):
    def exchanges(name):
        df = queries.QUERIES[name](spark, "/root/testdata/sf0.001")
        return df._jdf.queryExecution().executedPlan().toString().count("Exchange ")

    docs.reset_stages()
    adaptive = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")  # the plan shows its exchanges before it runs
    try:
        assert {n: exchanges(n) for n in ("normalize_text", "short_units", "token_freq")} == \
            {"normalize_text": 0, "short_units": 0, "token_freq": 1}
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", adaptive)
