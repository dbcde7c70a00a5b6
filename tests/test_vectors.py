"""Vocabulary, TF-IDF and labels on the fixtures of FIXTURES.md sections 3-5."""

import math

from pyspark.sql import functions as F

from kindred.functions import text as T
from kindred.operators import label as L
from kindred.operators import pairs as N
from kindred.operators import vectorize as V
from kindred.operators import vocab as VO
from kindred.sources import files as FS


def test_tfidf_fixture(spark):
    counts = spark.createDataFrame([(1, 0, 1), (1, 1, 1), (2, 0, 2)], "unit_id long, idx int, cnt long")
    w = {(r.unit_id, r.idx): r.w for r in V.tfidf(counts).collect()}
    assert abs(w[(1, 0)] - 0.579739) < 1e-6 and abs(w[(1, 1)] - 0.814802) < 1e-6
    assert abs(w[(2, 0)] - 1.0) < 1e-12
    d = N.cosine_within(V.tfidf(counts), 0.5, strategy="prefix").first()
    assert abs(d.dist - 0.420261) < 1e-6
    d2 = N.cosine_within(V.tfidf(counts), 0.5, strategy="blocks", dim=2).first()
    assert abs(d2.dist - 0.420261) < 1e-6


def test_vocabulary_fixture(spark, tmp_dir):
    rows = [(9, "begin_method"), (9, "alpha"), (5, "null"), (5, "foo-bar"), (3, "x1"), (1, "rare")]
    freq = spark.createDataFrame(rows, "frequency long, name string")
    order = [r.name for r in VO.sort_vocabulary(freq).collect()]
    assert order == ["begin_method", "alpha", "null", "foo-bar", "x1", "rare"]
    clean = {r.name for r in VO.clean_vocabulary(freq).collect()}
    assert "foo-bar" not in clean and len(clean) == 5
    cut = [r.name for r in VO.cut_vocabulary(freq, take=10, min_occurrences=3).orderBy("idx").collect()]
    assert cut == ["begin_method", "alpha", "null", "foo-bar", "x1"]
    assert VO.cut_vocabulary(freq, take=2, min_occurrences=1, inclusive=True).count() == 3
    path = f"{tmp_dir}/vocab"
    assert FS.write_vocabulary(freq, path) == 0
    back = FS.read_vocabulary(spark, f"{path}/*.csv", top=6)
    names = [r.name for r in back.orderBy("idx").collect()]
    assert "null" not in names and len(names) == 5  # NA rule: one short of top


def test_words_and_normalize(spark):
    df = spark.createDataFrame([("Foo.Bar x a-b élan_2 ¹",)], "t string")
    r = df.select(T.words("t").alias("w"), T.normalize("t").alias("n")).first()
    assert r.w == ["foo", "bar", "élan_2"]
    assert r.n == "foobar x a-b élan_2 ¹"


def test_tags_fixture(spark):
    rep = spark.createDataFrame([("\\a.cs", 3, "SQL_Injection"), ("\\a.cs", 3, "Reflected_XSS"),
                                 ("\\a.cs", 3, "SQL_Injection"), ("\\a.cs", 99, "Other")],
                                "f string, l int, name string")
    units = spark.createDataFrame([("\\a.cs", 3), ("\\a.cs", 9)], "f string, l int")
    got = {r.l: (r.tags, r.gt) for r in L.tag_units(units, rep, None, on=("f", "l")).collect()}
    assert got == {3: ("reflected_xss,sql_injection", 1), 9: ("", 0)}
    assert L.tag_units(units, rep, ["xss"], on=("f", "l")).where("l = 3").first().gt == 1
    assert L.tag_units(units, rep, ["overflow"], on=("f", "l")).where("l = 3").first().gt == 0


def test_partition_invariance(spark):
    import random
    random.seed(3)
    rows = [(u, random.randrange(30), random.randint(1, 4)) for u in range(120) for _ in range(12)]
    c = spark.createDataFrame(rows, "unit_id long, idx int, cnt long").groupBy("unit_id", "idx") \
        .agg(F.sum("cnt").alias("cnt"))
    a = {(r.unit_id, r.idx): round(r.w, 9) for r in V.tfidf(c.repartition(3)).collect()}
    b = {(r.unit_id, r.idx): round(r.w, 9) for r in V.tfidf(c.repartition(11)).collect()}
    assert a == b and math.isclose(sum(a.values()), sum(b.values()))
