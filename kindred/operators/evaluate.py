"""Evaluation: A8 confusion, R1 accuracy, R2 per-class report, R3 most confused,
R4 log confusion, P11 misclassified. All from the long ``label, prediction, n``
table, which has at most (classes^2) rows, so the report steps are tiny.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kindred.functions import text as T


def confusion(pred: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    """``label, prediction, n`` (rows = truth, columns = prediction)."""
    return pred.groupBy(F.col(label).alias("label"), F.col(prediction).alias("prediction")) \
        .agg(F.count(F.lit(1)).alias("n"))


def confusion_wide(conf: DataFrame) -> DataFrame:
    """A8 as a matrix: one column per predicted class."""
    return conf.groupBy("label").pivot("prediction").agg(F.sum("n")).na.fill(0)


def accuracy(conf: DataFrame) -> DataFrame:
    """Trace / total."""
    return conf.agg((F.sum(F.when(F.col("label") == F.col("prediction"), F.col("n")).otherwise(0))
                     / F.sum("n")).alias("accuracy"))


def class_report(conf: DataFrame) -> DataFrame:
    """R2: per class precision, recall, F1 (0 on zero denominators) and support,
    for classes present in the truth."""
    tp = conf.where(F.col("label") == F.col("prediction")).select(F.col("label").alias("class"),
                                                                  F.col("n").alias("tp"))
    sup = conf.groupBy(F.col("label").alias("class")).agg(F.sum("n").alias("support"))
    pcount = conf.groupBy(F.col("prediction").alias("class")).agg(F.sum("n").alias("predicted"))
    x = sup.join(tp, "class", "left").join(pcount, "class", "left").na.fill(0, ["tp", "predicted"])
    prec = F.when(F.col("predicted") > 0, F.col("tp") / F.col("predicted")).otherwise(0.0)
    rec = F.when(F.col("support") > 0, F.col("tp") / F.col("support")).otherwise(0.0)
    x = x.select("class", prec.alias("precision"), rec.alias("recall"), F.col("support").cast("long"))
    f1 = F.when(F.col("precision") + F.col("recall") > 0,
                2 * F.col("precision") * F.col("recall") / (F.col("precision") + F.col("recall"))) \
        .otherwise(0.0)
    return x.withColumn("f1", f1)


def class_means(report: DataFrame) -> DataFrame:
    """R2 averages: macro and support-weighted precision, recall, F1."""
    tot = F.sum("support")
    return report.agg(
        F.avg("precision").alias("macro_precision"), F.avg("recall").alias("macro_recall"),
        F.avg("f1").alias("macro_f1"),
        (F.sum(F.col("precision") * F.col("support")) / tot).alias("weighted_precision"),
        (F.sum(F.col("recall") * F.col("support")) / tot).alias("weighted_recall"),
        (F.sum(F.col("f1") * F.col("support")) / tot).alias("weighted_f1"))


def most_confused(conf: DataFrame) -> DataFrame:
    """For each true class, the other class it is most often predicted as
    (share of its row: by recall) and the other class most often predicted as
    it (share of its column: by precision), as ``name_0.1234``; ties to the
    lowest class id."""
    off = conf.where(F.col("label") != F.col("prediction"))
    row_tot = conf.groupBy("label").agg(F.sum("n").alias("rt"))
    col_tot = conf.groupBy("prediction").agg(F.sum("n").alias("ct"))
    by_row = off.join(row_tot, "label").withColumn("share", F.col("n") / F.col("rt"))
    w1 = Window.partitionBy("label").orderBy(F.desc("n"), F.asc("prediction"))
    r = by_row.withColumn("r", F.row_number().over(w1)).where("r = 1").select(
        F.col("label").alias("class"), T.format_share("prediction", "share").alias("by_recall"))
    by_col = off.join(col_tot, "prediction").withColumn("share", F.col("n") / F.col("ct"))
    w2 = Window.partitionBy("prediction").orderBy(F.desc("n"), F.asc("label"))
    p = by_col.withColumn("r", F.row_number().over(w2)).where("r = 1").select(
        F.col("prediction").alias("class"), T.format_share("label", "share").alias("by_precision"))
    classes = conf.select(F.col("label").alias("class")).distinct()
    return classes.join(r, "class", "left").join(p, "class", "left")


def log_confusion(conf: DataFrame) -> DataFrame:
    """``log10(n + 1)`` per cell."""
    return conf.withColumn("log_n", F.log10(F.col("n") + 1))


def misclassified(pred: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    """Rows whose prediction is wrong."""
    return pred.where(F.col(label) != F.col(prediction))
