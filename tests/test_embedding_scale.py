"""Unit embeddings without shuffled vectors; word lists stored before they are read twice."""

import numpy as np

from kindred.operators import embed as EM

LISTS = [(1, ["a", "b", "a"]), (2, ["zz"]), (3, []), (4, None), (5, ["b"]), (5, ["c", "b"]), (None, ["a"])]
VECTORS = {"a": [1.0, 2.0], "b": [0.0, -1.0], "c": [5.0, 5.0]}


def test_unit_embedding_is_the_mean_and_shuffles_no_vector_per_word(spark):
    lists = spark.createDataFrame(LISTS, "unit_id long, words array<string>")
    vectors = spark.createDataFrame([*VECTORS.items()], "word string, vector array<double>")
    emb = EM.unit_embedding(lists, vectors)
    got = {r.unit_id: r.embedding for r in emb.where("unit_id is not null").collect()}
    want = {1: ["a", "b", "a"], 2: [], 3: [], 4: [], 5: ["b", "c", "b"]}
    for unit, words in want.items():
        assert np.allclose(got[unit], np.mean([VECTORS[w] for w in words], axis=0) if words else [0.0, 0.0])
    assert "BroadcastHashJoin" in emb._jdf.queryExecution().executedPlan().toString()


def test_training_reads_a_stored_table(spark, monkeypatch):
    lists = spark.createDataFrame([(u, [f"w{(u + i) % 9}" for i in range(40)]) for u in range(30)],
                                  "unit_id long, words array<string>")
    seen = []
    fit = EM.Word2Vec.fit
    monkeypatch.setattr(EM.Word2Vec, "fit", lambda self, df: seen.append(df.inputFiles()) or fit(self, df))
    model = EM.train_word_vectors(lists, size=4, min_count=1, window=2)
    assert seen[0] and model.getVectors().count() == 9


def test_subsampling_keeps_rare_words_and_repeats_its_draw(spark):
    lists = spark.createDataFrame([(u, ["often"] * 50 + [f"rare{u}"]) for u in range(40)], "unit_id long, words array<string>")
    out = [r.words for r in EM.subsample_words(lists, 0.05, seed=1).orderBy("unit_id").collect()]
    assert out == [r.words for r in EM.subsample_words(lists.repartition(3), 0.05, seed=1).orderBy("unit_id").collect()]
    assert all(f"rare{u}" in w for u, w in enumerate(out))
    assert 0.1 < sum(w.count("often") for w in out) / 2000 < 0.4


def test_features_of_the_forest_are_made_once(spark, tmp_dir, monkeypatch):
    """E5: the forest's fit reads its rows several times; unit embeddings aren't in their plan."""
    from kindred.plans import queries as Q
    texts = [(u, " ".join(f"word{(u + k) % 7}" for k in range(200))) for u in range(40)]  # frequent words are subsampled
    spark.createDataFrame(texts, "doc_id long, text string").write.parquet(f"{tmp_dir}/documents.parquet")
    spark.createDataFrame([(u, 1, u % 2) for u in range(30)], "doc_id long, quality int, toxic int") \
        .write.parquet(f"{tmp_dir}/labels.parquet")
    monkeypatch.setattr(Q.CL, "fit_predict", lambda name, train, test, **how: train.unionByName(test))
    rows = Q.QUERIES["embedding_classifier"](spark, tmp_dir)
    plan = rows._jdf.queryExecution().optimizedPlan().toString()
    assert "Aggregate" not in plan and "Join" not in plan
    assert sorted(r.unit_id for r in rows.collect()) == list(range(30))
