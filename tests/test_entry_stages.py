"""Driver contract, staged pipeline and file sources."""

import os

import duckdb
from pyspark.sql import functions as F

import __spark_entry__ as E
from kindred.plans import stages as P
from kindred.sources import files as FS
from kindred.sources.tables import TABLES

SF = "/root/testdata/sf0.001"


def test_entry_runs(spark):
    df = E.entry(spark)
    assert df.columns == ["cluster_id", "size", "n_labelled", "n_toxic", "toxic_rate", "quality_rate"]
    assert df.count() >= 0


def test_oracle_keys_are_queries():
    assert set(E.oracle_sql()) <= set(E.queries())


def test_some_oracles_at_smallest_scale(spark):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    for name in ["tfidf_weights", "pair_distance_cosine", "clusters_single", "unit_lines", "knn_vote"]:
        s = E.queries()[name](spark, SF).toPandas()
        o = con.execute(E.oracle_sql()[name]).df()
        cols = sorted(s.columns)
        assert cols == sorted(o.columns)
        key = lambda df: sorted(tuple(round(x, 6) if isinstance(x, float) else x for x in r)
                                for r in df[cols].itertuples(index=False))
        assert key(s) == key(o), name


def test_pipeline_stages_reuse(spark, tmp_dir):
    units = spark.read.parquet(f"{SF}/documents.parquet").select(
        F.col("doc_id").alias("unit_id"), "text")
    out = P.run(spark, units, tmp_dir)
    n = out["clustering"].count()
    assert n == out["tfidf"].select("unit_id").distinct().count()
    mtime = os.path.getmtime(os.path.join(tmp_dir, "vectors"))
    out2 = P.run(spark, units, tmp_dir, stages=("clustering",))
    assert os.path.getmtime(os.path.join(tmp_dir, "vectors")) == mtime
    assert out2["clustering"].count() == n


def test_list_files_shards_and_repair(spark, tmp_dir):
    src = os.path.join(tmp_dir, "in")
    os.makedirs(src)
    for i in range(5):
        with open(os.path.join(src, f"f{i}.txt"), "wb") as f:
            f.write(b"a\xffb\n" if i == 0 else b"ok\n")
    files = FS.list_files(spark, src, start=1, end=4)
    assert sorted(r.file_idx for r in files.collect()) == [1, 2, 3]
    FS.repair_utf8(spark, os.path.join(src, "f0.txt"), os.path.join(tmp_dir, "clean"))
    assert spark.read.text(os.path.join(tmp_dir, "clean")).first().value == "a�b"
    allf = FS.list_files(spark, src)
    counts = allf.select("file", F.lit(0).alias("idx"), F.lit(1).alias("cnt"))
    assert FS.missing_shards(spark, allf, os.path.join(tmp_dir, "shards"), step=2).count() == 3
    FS.write_shards(counts.where(F.col("file").endswith("f0.txt")), allf,
                    os.path.join(tmp_dir, "shards"), step=2)
    assert sorted(r.shard for r in FS.missing_shards(spark, allf, os.path.join(tmp_dir, "shards"),
                                                     step=2).collect()) == [1, 2]
