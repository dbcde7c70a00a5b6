"""Classifiers and feature steps: M1-M12, V7-V9.

Estimators are ``pyspark.ml``; two have no Spark class and are built from
distributed pieces:

* AdaBoost (M9): the SAMME loop over ``DecisionTreeClassifier(maxDepth=1,
  weightCol=...)``; each round is one fit and one weighted error aggregate;
  weight tables are persisted, every fifth is a reliable checkpoint.
* Linear discriminant (M5): class means and the pooled within-class
  covariance are distributed aggregates (``RowMatrix.computeCovariance`` on
  centred rows); only the d x d solve runs on the driver, and scoring is a
  plain expression per class.
"""

from __future__ import annotations

import numpy as np
from pyspark.ml import Pipeline
from pyspark.ml.classification import (DecisionTreeClassifier, LinearSVC, LogisticRegression,
                                       MultilayerPerceptronClassifier, NaiveBayes, OneVsRest,
                                       RandomForestClassifier)
from pyspark.ml.feature import MinMaxScaler, PCA, StandardScaler, StringIndexer
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kindred.session import cut_lineage


def features(df: DataFrame, vec_col: str = "embedding", out: str = "features") -> DataFrame:
    """array column -> ml dense vector (JVM side)."""
    return df.withColumn(out, array_to_vector(F.col(vec_col).cast("array<double>")))


def dense_from_sparse(weights: DataFrame, dim: int, key: str = "idx", value: str = "w") -> DataFrame:
    """``unit_id, idx, w`` over a bounded vocabulary -> ``unit_id, features``.

    The cells of a unit are sorted and the gaps between them filled with zeros, so a
    row costs its dimension, not dimension times cells.
    """
    cell = F.struct(F.col(key).cast("int").alias("i"), F.col(value).cast("double").alias("x"))
    cells = weights.groupBy("unit_id").agg(F.map_from_entries(F.collect_list(cell)).alias("m")).select(
        "unit_id", F.sort_array(F.transform(
            F.filter(F.map_entries("m"), lambda e: (e["key"] >= 0) & (e["key"] < dim)),
            lambda e: F.struct(e["key"].alias("i"), F.coalesce(e["value"], F.lit(0.0)).alias("x")))).alias("c"))

    def gap(i, k):  # zeros between a cell and the one before it
        return F.array_repeat(F.lit(0.0), i - F.coalesce(F.get("c", k - 1)["i"], F.lit(-1)) - 1)

    filled = F.transform("c", lambda e, k: F.concat(gap(e["i"], k), F.array(e["x"])))
    end = F.array_repeat(F.lit(0.0), F.lit(dim - 1) - F.coalesce(F.get("c", F.size("c") - 1)["i"], F.lit(-1)))
    return cells.select("unit_id", array_to_vector(F.concat(F.flatten(filled), end)).alias("features"))


def estimator(name: str, n_features: int | None = None, n_classes: int | None = None, seed: int = 0):
    if name == "naive_bayes":          # M1
        return NaiveBayes(modelType="multinomial")
    if name == "logistic":             # M2
        return LogisticRegression(maxIter=100, regParam=0.0)
    if name == "tree":                 # M3
        return DecisionTreeClassifier(seed=seed)
    if name == "gaussian_nb":          # M6
        return NaiveBayes(modelType="gaussian")
    if name == "svm":                  # M7 (linear; one-vs-rest for many classes)
        return OneVsRest(classifier=LinearSVC(maxIter=100), parallelism=8)
    if name == "forest":               # M8
        return RandomForestClassifier(numTrees=100, seed=seed)
    if name == "mlp":                  # M10
        return MultilayerPerceptronClassifier(layers=[n_features, 100, n_classes], seed=seed, maxIter=200)
    raise ValueError(name)


def fit_predict(name: str, train: DataFrame, test: DataFrame, label: str = "label",
                id_col: str = "vec_id", seed: int = 0, keep: tuple = ()) -> DataFrame:
    """Fit on ``train`` (``features``, ``label``), predict ``test``:
    ``id, label, prediction`` (prediction as int) and the ``keep`` columns of ``test``."""
    train = train.withColumn("label", F.col(label).cast("double"))
    test = test.withColumn("label", F.col(label).cast("double"))
    if name == "adaboost":
        return adaboost_predict(train, test, id_col=id_col, keep=keep)
    if name == "lda":
        return lda_predict(train, test, id_col=id_col, keep=keep)
    n_features = n_classes = None
    if name == "mlp":
        n_features = len(train.select("features").first()[0])
        n_classes = int(train.agg(F.max("label")).first()[0]) + 1
    model = estimator(name, n_features, n_classes, seed).fit(train)
    return model.transform(test).select(id_col, F.col("label").cast("int").alias("label"),
                                        F.col("prediction").cast("int").alias("prediction"), *keep)


def adaboost_predict(train: DataFrame, test: DataFrame, rounds: int = 50, id_col: str = "vec_id",
                     checkpoint_every: int = 5, keep: tuple = ()) -> DataFrame:
    """M9: SAMME with depth-1 trees; returns test predictions.

    Where no tree is better than chance, the commonest class (of equals the
    smallest) is predicted.

    Weights stay normalised, so a round's new total is
    ``(1 - err) + err * exp(alpha)`` (no extra job). Rounds are persisted and
    every ``checkpoint_every``-th weight table is a reliable checkpoint.
    """
    from pyspark import StorageLevel
    k = int(train.agg(F.countDistinct("label")).first()[0])
    n = train.count()
    w = cut_lineage(train.select(id_col, "features", "label", F.lit(1.0 / n).alias("weight")))
    held = None  # the weights before ``w``, kept until ``w`` is filled
    learners = []
    for r in range(rounds):
        model = DecisionTreeClassifier(maxDepth=1, weightCol="weight", seed=r).fit(w)
        p = model.transform(w).withColumn("miss", (F.col("prediction") != F.col("label")).cast("double"))
        err = p.agg(F.sum(F.col("weight") * F.col("miss")) / F.sum("weight")).first()[0]
        if held is not None:
            held.unpersist()
            held = None
        if err >= 1.0 - 1.0 / k:
            break
        err = max(err, 1e-10)
        alpha = float(np.log((1 - err) / err) + np.log(k - 1))
        learners.append((model, alpha))
        if err <= 1e-10:
            break
        tot = (1.0 - err) + err * float(np.exp(alpha))
        nw = p.select(id_col, "features", "label",
                      (F.col("weight") * F.exp(F.lit(alpha) * F.col("miss")) / F.lit(tot)).alias("weight"))
        if (r + 1) % checkpoint_every == 0:
            nw = cut_lineage(nw)
        else:
            nw = nw.persist(StorageLevel.MEMORY_AND_DISK)
        held, w = w, nw
    for frame in (held, w):
        if frame is not None:
            frame.unpersist()
    if not learners:
        top = train.groupBy("label").count().orderBy(F.desc("count"), "label").first()["label"]
        return test.select(id_col, F.col("label").cast("int").alias("label"),
                           F.lit(int(top)).alias("prediction"), *keep)
    scores = None
    for i, (model, alpha) in enumerate(learners):
        s = model.transform(test).select(id_col, F.col("prediction").alias("c"),
                                         F.lit(alpha).alias("a"))
        scores = s if scores is None else scores.unionByName(s)
    votes = scores.groupBy(id_col, "c").agg(F.sum("a").alias("s"))
    from pyspark.sql import Window
    win = votes.withColumn("r", F.row_number().over(
        Window.partitionBy(id_col).orderBy(F.desc("s"), F.asc("c")))).where("r = 1")
    return test.select(id_col, F.col("label").cast("int").alias("label"), *keep).join(
        win.select(id_col, F.col("c").cast("int").alias("prediction")), id_col)


def lda_predict(train: DataFrame, test: DataFrame, id_col: str = "vec_id", keep: tuple = ()) -> DataFrame:
    """M5: linear discriminant with a pooled covariance (shrunk by 1e-6 on the diagonal)."""
    from pyspark.ml.functions import array_to_vector
    from pyspark.ml.stat import Correlation, Summarizer

    means = train.groupBy("label").agg(Summarizer.mean(F.col("features")).alias("mu"),
                                       F.count(F.lit(1)).alias("n"))
    mu_rows = means.collect()  # one row per class
    classes = [r["label"] for r in mu_rows]
    mu = {r["label"]: r["mu"].toArray() for r in mu_rows}
    n = {r["label"]: r["n"] for r in mu_rows}
    total = sum(n.values())
    mu_arr = means.select("label", vector_to_array("mu").alias("m"))
    centred = train.join(mu_arr, "label").select(
        array_to_vector(F.zip_with(vector_to_array("features"), "m", lambda a, b: a - b)).alias("c"))
    # both are JVM tree aggregates; the correlation holds the packed upper triangle of the products
    std = centred.select(Summarizer.std(F.col("c"))).first()[0].toArray()
    corr = np.nan_to_num(Correlation.corr(centred, "c").first()[0].toArray())
    np.fill_diagonal(corr, 1.0)
    cov = corr * np.outer(std, std) * (total - 1) / max(total - len(classes), 1)
    cov += np.eye(cov.shape[0]) * 1e-6
    inv = np.linalg.inv(cov)
    x = vector_to_array("features")
    best_s, best_c = None, None
    for c in sorted(classes):
        wv = inv @ mu[c]
        b = float(-0.5 * mu[c] @ wv + np.log(n[c] / total))
        s = F.aggregate(F.zip_with(x, F.array(*[F.lit(float(v)) for v in wv]), lambda a, q: a * q),
                        F.lit(0.0), lambda acc, v: acc + v) + F.lit(b)
        if best_s is None:
            best_s, best_c = s, F.lit(int(c))
        else:
            better = s > best_s
            best_c = F.when(better, F.lit(int(c))).otherwise(best_c)
            best_s = F.greatest(s, best_s)
    return test.select(id_col, F.col("label").cast("int").alias("label"),
                       best_c.cast("int").alias("prediction"), *keep)


def minmax(train: DataFrame, test: DataFrame, in_col: str = "features") -> DataFrame:
    """V7: min-max scaler fitted on train, applied to test (``scaled``)."""
    model = MinMaxScaler(inputCol=in_col, outputCol="scaled").fit(train)
    return model.transform(test)


def pca(df: DataFrame, k: int = 50, in_col: str = "features") -> DataFrame:
    """V8: centre (mean only), then PCA to ``k`` dimensions (``pca``)."""
    pipe = Pipeline(stages=[StandardScaler(inputCol=in_col, outputCol="__c", withMean=True, withStd=False),
                            PCA(k=k, inputCol="__c", outputCol="pca")])
    return pipe.fit(df).transform(df).drop("__c")


def label_index(df: DataFrame, col: str, out: str = "label_idx") -> DataFrame:
    """V9: integer codes in sorted order."""
    return StringIndexer(inputCol=col, outputCol=out, stringOrderType="alphabetAsc").fit(df) \
        .transform(df).withColumn(out, F.col(out).cast("int"))


def run_all(train: DataFrame, test: DataFrame, names=None, id_col: str = "vec_id") -> DataFrame:
    """``classifier, split, accuracy, macro_f1, weighted_f1``: every classifier fitted
    once and judged on the rows it learned from and on the others (R1, R2).

    The multinomial naive Bayes (M1) is left out: it takes no negative features.
    """
    from kindred.operators.evaluate import accuracy, class_means, class_report
    names = names or ["logistic", "tree", "gaussian_nb", "svm", "forest", "mlp", "lda", "adaboost"]
    both = train.withColumn("split", F.lit("train")).unionByName(test.withColumn("split", F.lit("test")))
    rows = []
    for nm in names:
        pred = fit_predict(nm, train, both, id_col=id_col, keep=("split",))
        cells = pred.groupBy("split", "label", "prediction").agg(F.count(F.lit(1)).alias("n")).collect()
        for part in ("train", "test"):  # at most classes^2 cells
            conf = train.sparkSession.createDataFrame(
                [(c["label"], c["prediction"], c["n"]) for c in cells if c["split"] == part],
                "label int, prediction int, n long")
            means = class_means(class_report(conf)).first()
            rows.append((nm, part, accuracy(conf).first()[0], means["macro_f1"], means["weighted_f1"]))
    return train.sparkSession.createDataFrame(
        rows, "classifier string, split string, accuracy double, macro_f1 double, weighted_f1 double")
