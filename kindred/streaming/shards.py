"""Incremental vectorisation (the streaming form of S10 + J8).

The reference skips shards whose vectors are already stored. Here new input
files arrive in a folder; a file-source stream picks up only files it has not
seen (tracked in its checkpoint, in the shared checkpoint folder), and each
micro-batch's term counts over a fixed vocabulary are appended to a stage
table, partitioned by batch id. A replayed batch overwrites its own partition,
so the sink is idempotent and a lost executor or restart never doubles rows.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kindred.operators import vectorize as V
from kindred.session import checkpoint_dir


def vectorize_stream(spark: SparkSession, source_glob: str, schema, vocab: DataFrame,
                     out_path: str, name: str = "vectors", id_col: str = "unit_id",
                     text_col: str = "text", fmt: str = "parquet", available_now: bool = True,
                     max_files_per_trigger: int = 100):
    """Start the stream; returns the ``StreamingQuery`` (already finished when
    ``available_now``). Output: ``unit_id, idx, cnt, batch``."""
    voc = vocab.select("name", "idx")  # a cut vocabulary: bounded, broadcast per batch
    stream = (spark.readStream.format(fmt).schema(schema)
              .option("maxFilesPerTrigger", max_files_per_trigger).load(source_glob))

    def write_batch(batch: DataFrame, batch_id: int) -> None:
        counts = V.term_counts(batch.select(F.col(id_col).alias("unit_id"), F.col(text_col).alias("text")),
                               voc)
        (counts.withColumn("batch", F.lit(batch_id))
         .write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
         .partitionBy("batch").parquet(out_path))

    ckpt = os.path.join(checkpoint_dir(spark), "streams", name)
    w = stream.writeStream.foreachBatch(write_batch).option("checkpointLocation", ckpt)
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="30 seconds")
    q = w.start()
    if available_now:
        q.awaitTermination()
    return q
