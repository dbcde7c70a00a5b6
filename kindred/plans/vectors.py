"""Dense-vector stages over ``embeddings`` (``vec_id, embedding, label``).

Settings: cosine pairs under 0.75 and Euclidean pairs under 1.2 (the
vectors are unit length, about 1-2 % of pairs fall under these); a 25 % test
split (seed 7) with a 5-nearest-neighbour vote; groups = ``label``, classes
by the median row sum inside each group.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from kindred.operators import pairs as N
from kindred.operators import sampling as SA
from kindred.operators import stats as SS
from kindred.sources.tables import load

T_COS = 0.75
T_EUC = 1.2
T_LINK = 0.7
T_WARD = 1.15
TEST_FRACTION = 0.25
SEED = 7
K = 5
PERCENT_YES = 0.5


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "embeddings", "vec_id", "embedding", "label")


def train_test(spark: SparkSession, sf_dir: str):
    return SA.split(vectors(spark, sf_dir), "vec_id", TEST_FRACTION, SEED)


def knn_predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M4: ``vec_id, label, prediction`` for the test rows (majority of the 5
    nearest training rows by Euclidean distance; ties to the lowest label)."""
    train, test = train_test(spark, sf_dir)
    nn = N.cross_nearest(test, train, K, "euclidean")
    lab = train.select(F.col("vec_id").alias("j"), F.col("label").alias("lj"))
    votes = nn.join(lab, "j").groupBy("i", "lj").agg(F.count(F.lit(1)).alias("c"))
    w = Window.partitionBy("i").orderBy(F.desc("c"), F.asc("lj"))
    win = votes.withColumn("r", F.row_number().over(w)).where("r = 1") \
        .select(F.col("i").alias("vec_id"), F.col("lj").alias("prediction"))
    return test.select("vec_id", "label").join(win, "vec_id")


def with_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A13 inside each group: class 0 when the row sum is above the group's median."""
    v = vectors(spark, sf_dir).withColumn("rsum", SS.row_sums(None))
    return SS.percentile_classes(v, "rsum", PERCENT_YES, "label")
