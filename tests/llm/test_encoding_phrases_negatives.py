"""Operators 11 to 13 against brute force, the library and exact integers."""

import hashlib
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_operators import SCHEMA, awkward

from kindred.llm import bpestream, collocations, hardneg, queries
from kindred.llm.tokens import vocabulary_path

PATH = vocabulary_path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def rows():
    return awkward()


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(5)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer
    return Tokenizer.from_file(PATH)


# ------------------------------------------------------------------ BPE streams (11)

PARTS = ["a", "b", "th", "ing", "'", "'re", "'s", " ", "  ", "\n", "\t", "é", "ß", "1", "23", "!", "--", "\x85", "\xa0",
         "İ", "字", "\x1c", "<|endoftext|>", "<|end", "́", "😀", "Ᲊ", "Ꟛ", "\x00", "͸"]


def streamed(codec, text, sizes):
    chunks, at = [], 0
    while at < len(text):
        n = sizes()
        chunks.append(text[at:at + n])
        at += n
    return np.frombuffer(b"".join(codec.encode_stream(chunks)), codec.dtype).tolist()


def test_streamed_ids_are_the_librarys(library):
    r, codec = random.Random(5), bpestream.codec(PATH)
    for _ in range(600):
        text = "".join(r.choice(PARTS) for _ in range(r.choice([0, 1, 3, 10, 40, 200])))
        want = library.encode(text, add_special_tokens=False).ids
        assert codec.encode(text).tolist() == want
        assert streamed(codec, text, lambda: r.choice([1, 2, 5, 30])) == want
        assert codec.decode(np.array(want, np.int64)) == library.decode(want, skip_special_tokens=False)


@pytest.mark.parametrize("alphabet", ["ab", "bicyclecl", " \n\t", " ", "0123456789", "-=*'\".", "aé字ж"])
def test_long_pieces_are_emitted_before_their_end(library, alphabet):
    r, codec = random.Random(7), bpestream.codec(PATH)
    for tail in ("", " x", "'re a"):
        text = "z " + "".join(r.choice(alphabet) for _ in range(30_000)) + tail
        assert streamed(codec, text, lambda: 777) == library.encode(text, add_special_tokens=False).ids
    stream = bpestream.ByteStream(codec)
    for _ in range(50):
        stream.push(b"ab" * 4000)
        assert len(stream.held) < bpestream.LONG + codec.lookahead


def test_random_ids_decode_as_the_librarys(library):
    r, codec = random.Random(9), bpestream.codec(PATH)
    for _ in range(300):
        ids = [r.randrange(codec.size) for _ in range(30)]
        assert codec.decode(np.array(ids)) == library.decode(ids, skip_special_tokens=False)
        assert "".join(codec.decode_stream([i] for i in ids)) == library.decode(ids, skip_special_tokens=False)


def test_lookahead_covers_every_interference():
    """Random merge lists: what follows the lookahead never changes a boundary."""
    r = random.Random(11)
    for _ in range(60):
        tokens, merges = [b"a", b"b", b"c"], []
        while len(merges) < 12:
            u, v = r.choice(tokens), r.choice(tokens)
            if u + v not in tokens and len(u + v) < 9:
                merges.append((u, v))
                tokens.append(u + v)
        far = bpestream.lookahead(merges)

        def ends(s):
            parts = [bytes([x]) for x in s]
            while True:
                ranks = [merges.index(p) if p in merges else 99 for p in zip(parts, parts[1:])]
                if not ranks or min(ranks) == 99:
                    return set(np.cumsum([len(p) for p in parts]).tolist())
                i = ranks.index(min(ranks))
                parts[i:i + 2] = [parts[i] + parts[i + 1]]

        for _ in range(60):
            s = bytes(r.choice(b"abc") for _ in range(far + 12))
            more = s + bytes(r.choice(b"abc") for _ in range(10))
            sure = len(s) - far
            assert {e for e in ends(s) if e <= sure} == {e for e in ends(more) if e <= sure}


def test_encode_and_decode_tables(docs, rows, empty, library):
    ids = bpestream.encode_texts(docs, PATH)
    assert ids.columns == docs.columns + ["ids"]
    got = bpestream.decode_ids(ids, PATH).collect()
    want = Counter((i, tuple(library.encode(t or "", add_special_tokens=False).ids), t or "") for i, t, *_ in rows)
    assert Counter((r.doc_id, tuple(r.ids), r.decoded) for r in got) == want
    assert bpestream.decode_ids(bpestream.encode_texts(empty, PATH), PATH).count() == 0


def test_op11_digests(spark, rows, library, tmp_path):
    spark.createDataFrame(rows, SCHEMA).write.parquet(str(tmp_path / "documents.parquet"))
    got = queries.op11_streaming_bpe(spark, str(tmp_path)).collect()
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    want = Counter()
    for i, t, *_ in rows:
        e = library.encode(t or "", add_special_tokens=False).ids
        want[(i, len(e), sha(",".join(map(str, e))), sha(library.decode(e, skip_special_tokens=False)))] += 1
    assert Counter(tuple(r) for r in got) == want


# ------------------------------------------------------------------ collocations (12)

def phrases(rows, least, top):
    f, n = Counter(), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        text = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split("[.,;:!?\n-\r]", text):
            w = re.findall("[^ \t]+", piece)
            n[lang] += len(w)
            for k in (1, 2, 3):
                for i in range(len(w) - k + 1):
                    f[lang, tuple(w[i:i + k])] += 1
    cand = {k: a for k, a in f.items() if len(k[1]) > 1 and a >= least}
    out = {}
    for (lang, p), a in cand.items():
        if any(len(q) > len(p) and o == lang and 100 * b >= 50 * a and p in (q[:2], q[1:])
               for (o, q), b in cand.items()):
            continue
        score, k = min((10 ** 6 * a * a // (f[lang, p[:k]] * f[lang, p[k:]]), k) for k in range(1, len(p)))
        out.setdefault(lang, []).append((-score, -a, " ".join(p).encode(), f[lang, p[:k]], f[lang, p[k:]]))
    return {(lang, i + 1, p.decode(), -a, l, r, n[lang], -s) for lang, x in out.items()
            for i, (s, a, p, l, r) in enumerate(sorted(x)[:top])}


def corpus(seed=3):
    r = random.Random(seed)
    words = ["ka", "Lo", "mi", "ru\x01", "é", "ta ne", "x", "\x00", "zz"]
    rows = []
    for i in range(150):
        t = "".join(r.choice(words) + r.choice([" ", " ", " ", "\t", "  ", ", ", ".\n", "\x0b", "\x85"])
                    for _ in range(r.choice([0, 1, 4, 60])))
        rows.append((r.choice(["en", "fr", "und", None, ""]), t))
    return rows + [("en", None), (None, None), ("de", "only once here"), ("en", "hot pair " * 3000)] + rows[:10]


@pytest.mark.parametrize("least,top", [(10, 2000), (3, 20)])
def test_collocations(spark, least, top):
    rows = corpus()
    d = spark.createDataFrame([(*x, 1, 1) for x in rows], "lang string, text string, a int, rank int").repartition(6)
    got = collocations.collocations(d, least=least, per_lang=top)
    assert got.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    assert {tuple(r) for r in got.collect()} == phrases(rows, least, top)


def test_blocks_of_any_size_give_the_same_counts(monkeypatch):
    import pyarrow as pa
    texts = [(lang or "und", (t or "").encode()) for lang, t in corpus()]

    def batches():
        return [pa.RecordBatch.from_pydict({"lang": [x for x, _ in texts], "text": [y for _, y in texts]})]

    def total():
        c = Counter()
        for b in collocations._words_and_pairs(batches()):
            for lang, w1, w2, w3, n in zip(*[x.to_pylist() for x in b.columns]):
                c[lang, w1, w2, w3] += n
        return c

    whole = total()
    monkeypatch.setattr(collocations, "BLOCK_BYTES", 300)
    assert total() == whole


def test_a_full_filter_changes_nothing(spark, monkeypatch):
    rows = corpus(8)
    d = spark.createDataFrame(rows, "lang string, text string").repartition(3)
    monkeypatch.setattr(collocations, "pair_filter",
                        lambda pairs: np.full(collocations.FILTER_BITS // 8, 255, np.uint8))
    assert {tuple(r) for r in collocations.collocations(d).collect()} == phrases(rows, 10, 2000)


def test_collocations_of_nothing(spark, empty):
    assert collocations.collocations(empty).count() == 0
    assert collocations.collocations(spark.createDataFrame([("en", "a b c")], "lang string, text string")).count() == 0


# ------------------------------------------------------------------ hard negatives (13)

def test_residue_products_are_exact():
    r = np.random.default_rng(0)
    for dim, top in ((1, 5), (64, 300), (700, 40_000), (300, 2 ** 22)):
        a, b = r.integers(-top, top + 1, (40, dim)), r.integers(-top, top + 1, (50, dim))
        a[0], b[0], b[1] = top, top, -top  # the largest and smallest scores
        got = hardneg.exact_products(a, b, hardneg.primes_for(dim * top * top))
        assert got.tolist() == (a.astype(object) @ b.T.astype(object)).tolist()


def negatives(rows):
    ok = [(i, lab, [int(np.floor(256 * float(x))) for x in v]) for i, v, lab in rows
          if i is not None and lab is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    dot = lambda a, b: sum(x * y for x, y in zip(a, b))
    out = Counter()
    for i, lab, q in ok:
        if i % 50:
            continue
        same = sorted((-dot(q, w), j) for j, m, w in ok if j != i and m == lab)[:5]
        other = sorted((-dot(q, w), j) for j, m, w in ok if j != i and m != lab)
        for s, j in same:
            fit = [(t, k) for t, k in other if 50 * -s <= 100 * -t <= 95 * -s][:3]
            for n, (t, k) in enumerate(fit):
                out[(i, j, n + 1, k, -s, -t)] += 1
    return out


@pytest.mark.parametrize("block", [2048, 16])
def test_hard_negatives(spark, block, monkeypatch):
    r = random.Random(2)
    base = [[r.uniform(-1, 1) for _ in range(6)] for _ in range(40)]
    rows = [(i, [x + r.uniform(-.2, .2) for x in base[i % 40]], r.randrange(3)) for i in range(300)]
    rows += [(300 + i, base[0], i % 2) for i in range(40)]  # ties
    rows += [(500, None, 1), (501, [], 1), (502, [1.0], 0), (503, [float("nan")] * 6, 1), (504, [None] * 6, 0),
             (505, [float("inf")] + [0.0] * 5, 0), (506, base[1], None), (None, base[2], 1), (507, [0.0] * 6, 2)]
    rows += [rows[3], rows[0], rows[50]]  # repeated candidates and anchors
    monkeypatch.setattr(hardneg, "BLOCK", block)
    d = spark.createDataFrame([(*x, 1, 1) for x in rows],
                              "vec_id long, embedding array<double>, label int, block int, rank int").repartition(4)
    got = hardneg.mine(d, "vec_id % 50 = 0")
    assert Counter(tuple(x) for x in got.collect()) == negatives(rows)


def test_hard_negatives_of_nothing(spark):
    schema = "vec_id long, embedding array<float>, label int"
    assert hardneg.mine(spark.createDataFrame([], schema), "vec_id % 50 = 0").count() == 0
    assert hardneg.mine(spark.createDataFrame([(0, [1.0], 1)], schema), "vec_id % 50 = 0").count() == 0
    with pytest.raises(ValueError, match="2\\^56"):
        hardneg.mine(spark.createDataFrame([(0, [1e30], 1)], schema), "vec_id % 50 = 0")
    assert hardneg.mine(spark.createDataFrame([(0, [1.0], 1)], schema).where(F.lit(False)), "vec_id = 0").count() == 0
