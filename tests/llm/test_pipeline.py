"""Every stage of the corpus pipeline against a brute-force version, each on its own input."""

import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from kindred.llm import fairmix, toxicity
from kindred.llm.tokens import vocabulary_path
from tests.llm.test_operators import awkward, crc, ids_of, norm, shingle_set

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, n long"
STAGE = dict(corpus_pipeline.STAGES)
COLUMNS = corpus_pipeline.COLUMNS


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    """Documents with every awkward row and toxic ones, and their labels, as a folder of tables."""
    r = random.Random(9)
    rows = [(i, t, lang, s, None, 1.0, 1) for i, t, lang, s, *_ in awkward()]
    labels = [(i, 0) for i, *_ in rows if i is not None]
    for i in range(1000, 1080):
        y = i % 3 == 0
        words = [r.choice(["table", "river", "window", "garden", "music"]) + r.choice("abcdef") for _ in range(25)]
        rows.append((i, " ".join(words + ["vilemonger", "rotterish"] * y), "en", f"s{i % 3}", None, 1.0, 1))
        labels.append((i, int(y)))
    labels += [(None, 1), (5000, None), labels[0]]
    at = str(tmp_path_factory.mktemp("corpus"))
    spark.createDataFrame(rows, SCHEMA).repartition(4).write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, toxic int").write.parquet(f"{at}/labels.parquet")
    return at


def rows_of(df):
    return [tuple(r) for r in df.select(COLUMNS).collect()]


def brute_scores(spark, docs, at):
    """Score of each text by all its cosines, with the fitted weights and curve."""
    index = toxicity.fit(docs, spark.read.parquet(f"{at}/labels.parquet").select("doc_id", "toxic"))
    rows = rows_of(docs)
    counts = [Counter(t for w in toxicity.text_words(r[1]) for t in toxicity.word_terms(w)) for r in rows]
    df = Counter(t for c in counts for t in c)
    known = set(index.known.tolist())

    def unit(c):
        v = {t: (1 + np.log(n)) * max(0.1, 1 + np.log(len(rows) / (1 + df[t]))) for t, n in c.items() if t in known}
        length = np.sqrt(sum(x * x for x in v.values()))
        return {t: x / length for t, x in v.items()}
    of_id = {}
    for r, c in zip(rows, counts):
        if r[0] not in of_id or (r[1] or "") < of_id[r[0]][0]:
            of_id[r[0]] = (r[1] or "", unit(c))
    examples = [(i, y, of_id[i][1]) for i, y in zip(index.ids.tolist(), index.labels.tolist())]
    out = []
    for r, c in zip(rows, counts):
        v = unit(c)
        near = sorted((-round(sum(w * e.get(t, 0.0) for t, w in v.items()), 12), i, y)
                      for i, y, e in examples if i != r[0])
        near = [(-c, y) for c, _, y in near if c < 0][:index.k]
        if not near:
            out.append(index.blank)
            continue
        w = [index.class_weight[y] / (1.05 - min(c, 1.0)) for c, y in near]
        p = (sum(a for a, (_, y) in zip(w, near) if y == 1) + index.prior) / (sum(w) + 1)
        p = min(max(p, 0.005), 0.995)
        out.append(1 / (1 + np.exp(-(index.curve[0] * np.log(p / (1 - p)) + index.curve[1]))))
    return rows, out


def test_each_stage_and_the_run(spark, corpus, tmp_path):
    def stored(df, name):
        df.write.parquet(f"{tmp_path}/{name}")
        return spark.read.parquet(f"{tmp_path}/{name}")
    docs = spark.read.parquet(f"{corpus}/documents.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "exact_dedup", "near_dedup", "mixing", "packing"]

    rows, scores = brute_scores(spark, docs, corpus)
    assert min(abs(s - 0.5) for s in scores) > 1e-6
    clean = stored(STAGE["toxicity"](spark, docs, corpus), "toxicity")
    assert clean.columns == COLUMNS
    assert Counter(rows_of(clean)) == Counter(r for r, s in zip(rows, scores) if s < 0.5)
    left = {r[0] for r in rows_of(clean)}
    assert not any(i in left for i in range(1002, 1080, 3)) and all(i in left for i in range(1000, 1080) if i % 3)

    unique = stored(STAGE["exact_dedup"](spark, clean, corpus), "exact")
    groups = {}
    for r in rows_of(clean):
        groups.setdefault(norm(r[1]), []).append(r)
    got = {norm(r[1]): r for r in rows_of(unique)}
    assert unique.columns == COLUMNS and len(got) == len(groups) == unique.count()
    for text, group in groups.items():
        assert got[text] in group
        assert got[text][0] == min((r[0] for r in group if r[0] is not None), default=None)

    apart = stored(STAGE["near_dedup"](spark, unique, corpus), "near")
    linked = []  # sets of rows
    for r in rows_of(unique):
        s = shingle_set(r[1])
        meets = [g for g in linked if s and any(100 * len(s & x) >= 75 * len(s | x) for _, x in g if x)]
        linked = [g for g in linked if g not in meets] + [sum(meets, [(r, s)])]
    assert any(len(g) > 1 for g in linked)
    want = [min(g, key=lambda x: (x[0][0] is None, x[0][0] or 0))[0] for g in linked]
    assert apart.columns == COLUMNS and Counter(rows_of(apart)) == Counter(want)

    mixed = stored(STAGE["mixing"](spark, apart, corpus), "mixing")
    times = {r.doc_id: int(r.taken / r["size"] + 0.5) for r in fairmix.fair_mix(apart).collect() if r["size"]}
    assert mixed.columns == COLUMNS
    assert Counter(rows_of(mixed)) == Counter({r: times[r[0]] for r in rows_of(apart) if times.get(r[0])})

    path = vocabulary_path("word_bpe_49k.json")
    pieces = STAGE["packing"](spark, mixed, corpus).collect()
    tokens = Counter()
    for r in rows_of(mixed):
        ids = ids_of(path, r[1], 1)
        tokens[(r[0], len(ids))] += len(ids)
    have, filled = Counter(), Counter()
    for p in pieces:
        have[(p.doc_id, p.doc_tokens)] += p.length
        filled[p.sequence_id] += p.length
        if p.length == p.doc_tokens:
            text = next(r[1] for r in rows_of(mixed) if r[0] == p.doc_id) if p.doc_id in (1, 1000) else None
            assert text is None or p.ids_crc32 == crc(ids_of(path, text, 1))
    assert have == tokens and sorted(filled) == list(range(len(filled)))
    assert all(n == 2048 or n & (n - 1) == 0 for n in filled.values())

    out = corpus_pipeline.run(spark, corpus)
    assert Counter(map(tuple, out.collect())) == Counter(
        (p.doc_id, p.start, p.length, p.ids_crc32, p.doc_tokens, p.sequence_id, p.offset) for p in pieces)


def test_stages_of_nothing(spark, corpus):
    docs = spark.read.parquet(f"{corpus}/documents.parquet").where(F.lit(False))
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, corpus).count() == 0, name
