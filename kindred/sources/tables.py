"""Driver tables (one parquet file per table) with column pruning."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession

TABLES = ("region", "nation", "customer", "supplier", "part", "orders",
          "lineitem", "events", "documents", "embeddings", "pages",
          "benchmark", "labels", "conversations")


def table_path(sf_dir: str, name: str) -> str:
    return os.path.join(sf_dir, f"{name}.parquet")


def load(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    """Read one table; naming columns prunes the parquet scan to them."""
    df = spark.read.parquet(table_path(sf_dir, name))
    return df.select(*columns) if columns else df


def units_from_documents(spark: SparkSession, sf_dir: str, *extra: str) -> DataFrame:
    """Documents as units: ``unit_id, text`` (+ extra columns).

    One task reads a whole row group, so a file with a single one keeps all but
    one core idle. The session setting ``spark.kindred.scan.tasks`` deals such
    units to that many tasks, at the price of a shuffle of the texts; it is off by
    default, as large inputs have row groups enough.
    """
    cols = ["doc_id", "text", *extra]
    units = load(spark, sf_dir, "documents", *cols).withColumnRenamed("doc_id", "unit_id")
    tasks = int(spark.conf.get("spark.kindred.scan.tasks", "0"))
    return units.repartition(tasks, "unit_id") if tasks else units
