"""Incremental vectorisation: new files only, and a restart adds nothing twice."""

import os

from pyspark.sql import functions as F

from kindred.streaming.shards import vectorize_stream


def test_stream_picks_up_new_files_once(spark, tmp_dir):
    src = os.path.join(tmp_dir, "in")
    os.makedirs(src)
    schema = "unit_id long, text string"
    spark.createDataFrame([(1, "alpha beta alpha"), (2, "beta gamma")], schema) \
        .coalesce(1).write.mode("append").parquet(src)
    vocab = spark.createDataFrame([("alpha", 0), ("beta", 1), ("gamma", 2)], "name string, idx int")
    out = os.path.join(tmp_dir, "out")
    name = "t" + os.path.basename(tmp_dir)
    vectorize_stream(spark, src, spark.createDataFrame([], schema).schema, vocab, out, name=name)
    first = {(r.unit_id, r.idx): r.cnt for r in spark.read.parquet(out).collect()}
    assert first == {(1, 0): 2, (1, 1): 1, (2, 1): 1, (2, 2): 1}
    # restart with nothing new: no rows are added again
    vectorize_stream(spark, src, spark.createDataFrame([], schema).schema, vocab, out, name=name)
    assert spark.read.parquet(out).count() == 4
    # a new file: only its rows are added
    spark.createDataFrame([(3, "gamma gamma")], schema).coalesce(1).write.mode("append").parquet(src)
    vectorize_stream(spark, src, spark.createDataFrame([], schema).schema, vocab, out, name=name)
    got = spark.read.parquet(out)
    assert got.count() == 5 and got.where(F.col("unit_id") == 3).first().cnt == 2
