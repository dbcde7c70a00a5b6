"""Distributed row numbers in a total order, without a one-partition window.

``Window.orderBy(...)`` with no partition moves every row into one task. Here
the rows are range-partitioned and sorted (``orderBy``), the sorted result is
checkpointed (so its partitions are stable), each partition's row count is
read (one small row per partition), and a row's number is its partition's
offset plus its place inside the partition.
"""

from __future__ import annotations

from itertools import accumulate

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kindred.session import cut_lineage


def global_row_number(df: DataFrame, *order, name: str = "rank", start: int = 1) -> DataFrame:
    spark = df.sparkSession
    s = cut_lineage(df.orderBy(*order))
    s = s.withColumn("__pid", F.spark_partition_id()) \
        .withColumn("__mid", F.monotonically_increasing_id())
    counts = {r["__pid"]: r["n"] for r in
              s.groupBy("__pid").agg(F.count(F.lit(1)).alias("n")).collect()}
    pids = sorted(counts)
    offs = [0] + list(accumulate(counts[p] for p in pids))[:-1]
    table = spark.createDataFrame([(p, o) for p, o in zip(pids, offs)] or [(0, 0)],
                                  "__pid int, __off long")
    within = F.col("__mid") - F.shiftleft(F.col("__pid").cast("long"), 33)
    return s.join(F.broadcast(table), "__pid") \
        .withColumn(name, (F.col("__off") + within + F.lit(start)).cast("long")) \
        .drop("__pid", "__mid", "__off")


def running_sums(df: DataFrame, part_col: str, order_col: str, values: dict) -> DataFrame:
    """Inclusive running sums of ``values`` (name -> Column) per ``part_col`` in
    ``order_col`` order, without one task per part.

    Rows are range-sorted on (part, order) and checkpointed; each
    (partition, part) slice gets the totals of the same part in earlier
    partitions as an offset (a window over at most #partitions rows per part);
    the running sum inside a slice is a window over (part, partition), so a
    part that holds a third of all rows is still summed by many tasks.
    """
    names = list(values)
    s = cut_lineage(df.select("*", *[c.alias(f"__v_{n}") for n, c in values.items()])
                    .orderBy(part_col, order_col))
    s = s.withColumn("__pid", F.spark_partition_id())
    tot = s.groupBy(part_col, "__pid").agg(*[F.sum(f"__v_{n}").alias(f"__t_{n}") for n in names])
    before = Window.partitionBy(part_col).orderBy("__pid").rowsBetween(Window.unboundedPreceding, -1)
    offs = tot.select(part_col, "__pid", *[F.coalesce(F.sum(f"__t_{n}").over(before), F.lit(0))
                                          .alias(f"__o_{n}") for n in names])
    local = Window.partitionBy(part_col, "__pid").orderBy(order_col) \
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    x = s.join(offs, [part_col, "__pid"])
    for n in names:
        x = x.withColumn(n, F.col(f"__o_{n}") + F.sum(f"__v_{n}").over(local))
    return x.drop("__pid", *[f"__{k}_{n}" for n in names for k in ("v", "o")])
