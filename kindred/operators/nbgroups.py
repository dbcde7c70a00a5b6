"""Multinomial naive Bayes per group against one pooled model, as
grouped aggregates (no estimator object, no per-group collect).

Per (scope, class, term): summed counts -> Laplace-smoothed log probability;
per (scope, class): log prior. A test unit's score for a class is its counts
dotted with the log probabilities (a join on term, then a sum) plus the prior;
the prediction is the best class (ties: lowest). Scope is the group for the
per-group models and ``-1`` for the pooled one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kindred.operators import sampling as SA


def per_group_vs_pooled(counts: DataFrame, units: DataFrame, n_terms: int, alpha: float = 1.0,
                        test_fraction: float = 0.25, seed: int = 0) -> DataFrame:
    """``units``: ``unit_id, cluster_id, label``. Returns ``scope, unit_id, label, prediction``."""
    train, test = SA.split(units, "unit_id", test_fraction, seed)
    scoped = lambda df: df.withColumn("scope", F.col("cluster_id")).unionByName(
        df.withColumn("scope", F.lit(-1).cast(df.schema["cluster_id"].dataType)))
    tr = scoped(train)
    te = scoped(test)
    tc = counts.join(tr.select("unit_id", "scope", "label"), "unit_id")
    per_term = tc.groupBy("scope", "label", "idx").agg(F.sum("cnt").alias("c"))
    per_class = tc.groupBy("scope", "label").agg(F.sum("cnt").alias("tot"))
    logp = per_term.join(per_class, ["scope", "label"]).select(
        "scope", "label", "idx",
        (F.log(F.col("c") + alpha) - F.log(F.col("tot") + alpha * n_terms)).alias("lp"))
    n_scope = tr.groupBy("scope").agg(F.count(F.lit(1)).alias("n"))
    prior = tr.groupBy("scope", "label").agg(F.count(F.lit(1)).alias("nc")).join(n_scope, "scope") \
        .join(per_class, ["scope", "label"]).select(
            "scope", "label", (F.log("nc") - F.log("n")).alias("prior"),
            F.log(F.col("tot") + alpha * n_terms).alias("den"))
    # unseen terms of a class get log(alpha / (tot + alpha * V)): score = sum cnt * lp over seen
    # terms + (sum cnt over unseen) * log(alpha) - (sum cnt) * den_unseen, written as below
    tu = counts.join(te.select("unit_id", "scope"), "unit_id")
    cand = tu.join(prior.select("scope", "label"), "scope")
    seen = cand.join(logp, ["scope", "label", "idx"], "left")
    base = F.log(F.lit(alpha))
    scores = seen.groupBy("scope", "unit_id", "label").agg(
        F.sum(F.col("cnt") * F.col("lp")).alias("s_seen"),
        F.sum(F.when(F.col("lp").isNull(), F.col("cnt")).otherwise(0)).alias("unseen"),
        F.sum("cnt").alias("total"))
    scores = scores.join(prior, ["scope", "label"]).select(
        "scope", "unit_id", "label",
        (F.coalesce("s_seen", F.lit(0.0)) + F.col("unseen") * (base - F.col("den"))
         + F.col("prior")).alias("score"))
    w = Window.partitionBy("scope", "unit_id").orderBy(F.desc("score"), F.asc("label"))
    best = scores.withColumn("r", F.row_number().over(w)).where("r = 1") \
        .select("scope", "unit_id", F.col("label").alias("prediction"))
    return te.select("scope", "unit_id", "label").join(best, ["scope", "unit_id"])
