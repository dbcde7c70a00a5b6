"""Linear discriminant, subsampling and the real Jaccard distance against plain versions."""

import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from kindred.operators import classify, embed, pairs


def test_linear_discriminant_equals_numpy(spark):
    rng = np.random.default_rng(3)
    centres = rng.standard_normal((3, 6)) * 1.2
    y = rng.integers(0, 3, 300)
    x = centres[y] + rng.standard_normal((300, 6)) @ rng.standard_normal((6, 6)) * 0.6
    x[:, 5] = 7.0  # a constant feature
    rows = [(int(i), x[i].tolist(), float(y[i])) for i in range(300)]
    d = classify.features(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label double"))
    train, test = d.where("vec_id < 200"), d.where("vec_id >= 200")
    got = {r.vec_id: r.prediction for r in classify.lda_predict(train, test).collect()}
    a, b = x[:200], y[:200]
    mu = np.array([a[b == c].mean(0) for c in range(3)])
    cov = (a - mu[b]).T @ (a - mu[b]) / (200 - 3) + np.eye(6) * 1e-6
    w = np.linalg.solve(cov, mu.T)
    s = x[200:] @ w - 0.5 * (mu * w.T).sum(1) + np.log(np.bincount(b) / 200)
    assert [got[i] for i in range(200, 300)] == s.argmax(1).tolist()


def test_subsampling(spark):
    r = random.Random(1)
    lists = [(i, ["the"] * r.randrange(40) + [f"w{r.randrange(500)}" for _ in range(60)]) for i in range(30)]
    lists += [(40, []), (41, ["the"])]
    d = spark.createDataFrame(lists, "unit_id long, words array<string>").repartition(4)
    n = Counter(w for _, ws in lists for w in ws)
    total, t = sum(n.values()), 0.01

    def stays(unit, place, word):
        draw = int(hashlib.md5(f"{unit}:{place}:5".encode()).hexdigest()[:8], 16) / 16 ** 8
        return n[word] <= t * total or draw < (t * total / n[word]) ** 0.5

    want = {u: [w for i, w in enumerate(ws) if stays(u, i, w)] for u, ws in lists}
    got = {x.unit_id: x.words for x in embed.subsample_words(d, t, 5).collect()}
    assert got == want and 0 < sum(map(len, got.values())) < total
    assert embed.subsample_words(d.where("false"), t).count() == 0
    assert embed.subsample_words(d, 1.0).count() == len(lists)  # nothing is that frequent


@pytest.mark.parametrize("t", [0.2, 0.5, 0.8, 1.0])
def test_jaccard_of_real_vectors(spark, t):
    rng = np.random.default_rng(4)
    x = rng.integers(0, 3, (60, 8)) * (rng.random((60, 8)) < 0.7) * 0.5
    x[10:20] = x[0:10]  # copies
    x[20:25, 0] = 9.0
    x[30] = 0.0
    cells = [(i, k, float(x[i, k])) for i in range(60) for k in range(8)]
    d = spark.createDataFrame(cells, "unit_id long, idx int, cnt double").repartition(5)
    want = {}
    for i in range(60):
        for j in range(i + 1, 60):
            either = (x[i] != 0) | (x[j] != 0)
            if x[i].any() and x[j].any() and (dist := ((x[i] != x[j]) & either).sum() / either.sum()) < t:
                want[i, j] = pytest.approx(dist)
    assert {(r.i, r.j): r.dist for r in pairs.jaccard_cells_within(d, t).collect()} == want
    with pytest.raises(ValueError):
        pairs.jaccard_cells_within(d, 1.1)


def test_all_classifiers_learn(spark):
    rng = np.random.default_rng(8)
    y = np.arange(240) % 3
    x = np.eye(3)[y] * 4 + rng.standard_normal((240, 3)) * 0.5
    d = classify.features(spark.createDataFrame([(i, x[i].tolist(), int(y[i])) for i in range(240)],
                                                "vec_id long, embedding array<double>, label int")).cache()
    got = {(r.classifier, r.split): r for r in classify.run_all(d.where("vec_id < 180"), d.where("vec_id >= 180")).collect()}
    assert len(got) == 16 and {s for _, s in got} == {"train", "test"}
    for (name, _), r in got.items():
        assert r.accuracy > 0.9 and r.macro_f1 > 0.9 and r.weighted_f1 > 0.9, (name, r)


def test_boosting_without_a_learner_predicts_the_commonest_class(spark):
    rows = [(i, [1.0, 1.0], float(i % 3 == 0)) for i in range(9)] + [(i, [1.0, 1.0], 1.0) for i in range(9, 12)]
    d = classify.features(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label double"))
    got = classify.adaboost_predict(d, d).collect()
    assert len(got) == 12 and {r.prediction for r in got} == {0}
