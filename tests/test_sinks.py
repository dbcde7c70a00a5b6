"""Sinks S12-S15 and path mapping P8."""

import json
import os

from pyspark.sql import functions as F

from kindred.functions import text as T
from kindred.operators import embed as EM
from kindred.operators import evaluate as EV
from kindred.sources import files as FS


def test_path_map(spark):
    df = spark.createDataFrame([("/d/tokenized1/a/b.cs.tree-viewer.txt",),
                                ("C:\\d\\tokenized1\\x.cs.tree-viewer.txt",)], "p string")
    r = df.select(T.report_name("p").alias("n"), T.source_path("p").alias("s")).collect()
    assert r[0].n == "\\a/b.cs" and r[0].s == "/d/c_sharp_code/a/b.cs"
    assert r[1].n == "\\x.cs" and r[1].s == "C:\\d\\c_sharp_code\\x.cs"


def test_class_report_csv(spark, tmp_dir):
    conf = spark.createDataFrame([(0, 0, 5), (0, 1, 1), (1, 0, 2), (1, 1, 2)],
                                 "label int, prediction int, n long")
    FS.write_class_report(EV.class_report(conf), f"{tmp_dir}/rep")
    back = spark.read.csv(f"{tmp_dir}/rep", header=True).collect()
    assert [r["class"] for r in back] == ["1", "0"]  # sorted by recall
    assert back[1].precision == "0.7143"


def test_cluster_listing_and_nearest(spark, tmp_dir):
    listing = spark.createDataFrame([(i, i // 20, f"t{i}") for i in range(30)],
                                    "unit_id long, cluster_id long, text string")
    FS.write_cluster_listing(listing, f"{tmp_dir}/list", max_size=15)
    back = spark.read.json(f"{tmp_dir}/list")
    flags = {r.cluster_id: r.interesting for r in back.select("cluster_id", "interesting").distinct().collect()}
    assert flags == {0: True, 1: False}
    nearest = spark.createDataFrame([(1, 2, 0.1)], "i long, j long, dist double")
    texts = spark.createDataFrame([(1, "a"), (2, "b")], "id long, text string")
    FS.write_nearest_report(nearest, texts, f"{tmp_dir}/near")
    r = spark.read.json(f"{tmp_dir}/near").first()
    assert (r.text_i, r.text_j) == ("a", "b")


def test_word_vectors_save_load(spark, tmp_dir):
    lists = spark.createDataFrame([(i, ["alpha", "beta", "gamma", "delta"] * 5) for i in range(20)],
                                  "unit_id long, words array<string>")
    path = f"{tmp_dir}/w2v"
    m1 = EM.load_or_train(lists, path, size=8, min_count=1, window=2)
    assert os.path.exists(path)
    m2 = EM.load_or_train(lists, path)
    v1 = {r.word: r.vector for r in EM.word_vectors(m1).collect()}
    v2 = {r.word: r.vector for r in EM.word_vectors(m2).collect()}
    assert v1 == v2 and set(v1) == {"alpha", "beta", "gamma", "delta"}
    emb = EM.unit_embedding(lists.withColumn("words", F.array_union("words", F.array(F.lit("zzz")))),
                            EM.word_vectors(m1)).first()
    assert len(emb.embedding) == 8  # unknown word skipped, mean of the known ones
