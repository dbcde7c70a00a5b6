"""Each operator against a brute-force version on small, awkward tables."""

import base64
import hashlib
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from kindred.llm import (boundaries, contentsort, fairmix, hilbert, jaccardjoin, jumphash, onebit,
                         pseudonyms, toxicity, warc)
from kindred.llm.tokens import ChunkEncoder, vocabulary_path

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, h long, row int, size long, salt int"


def awkward(seed=1, n=60):
    """Nulls, empty and long texts, ties, repeated rows, near copies, clashing columns."""
    r = random.Random(seed)
    words = [a + b for a in "ka lo mi ru".split() for b in "ta ne so vi pu".split()]
    texts = [" ".join(r.choice(words) for _ in range(r.choice([1, 3, 8, 40, 90]))) for _ in range(n)]
    for i in range(5, n, 6):
        w = texts[i - 1].split()
        w[r.randrange(len(w))] = "edit"
        texts[i] = " ".join(w)
    texts += [None, None, "", " ", "\t\n", texts[0], texts[0].replace(" ", "\n\n"), texts[3].upper(), "x" * 40_000,
              " ".join(words * 400), "a  b ", "<|endoftext|> x", "Été   İ ΣΑΣ"]
    rows = [(i, t, "en", None if i % 7 == 0 else f"s{i % 4}", None, 1, 1, 1, 1) for i, t in enumerate(texts)]
    return rows + rows[:3] + [(None, "nobody's text here", None, "s1", None, 1, 1, 1, 1)]


@pytest.fixture(scope="module")
def rows():
    return awkward()


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(5)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def ids_of(path, text, end):
    from tokenizers import Tokenizer
    return Tokenizer.from_file(path).encode(text or "", add_special_tokens=False).ids + [end]


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


# ------------------------------------------------------------------ tokens, token files (1)

@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_chunked_ids_are_the_librarys(name, rows):
    enc = ChunkEncoder(vocabulary_path(name), max_chunks=20)
    texts = [t or "" for _, t, *_ in rows] + ["it's  'll  done 'S", " \n y\t z\n\n k  ", "w,\x01 \x01 v!?", "é ́x"]
    for part in (texts[:10], texts, texts):
        assert [enc.ids(p).tolist() for p in enc.encode(part)] == [
            enc.tok.encode(t, add_special_tokens=False).ids for t in part]


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_every_letter_beside_punctuation_and_marks(name):
    """Letters that the tokenizer takes apart, and all the others."""
    enc = ChunkEncoder(vocabulary_path(name))
    letters = [chr(c) for c in range(0x30000) if chr(c).isalpha()]
    letters = [c for c in letters if not "\u4e00" <= c <= "\u9fff" and not "\uac00" <= c <= "\ud7a3" and c < "\U00020000"]
    texts = ["x " + " ".join(f"ab{c}{tail}" for c in letters[i:i + 50]) for tail in (".", "!?", "\u0301,", "")
             for i in range(0, len(letters), 50)]
    for part in (texts[:len(texts) // 2], texts[len(texts) // 2:]):
        want = enc.tok.encode_batch_fast(part, add_special_tokens=False)
        bad = [t for t, p, w in zip(part, enc.encode(part), want) if enc.ids(p).tolist() != w.ids]
        assert not bad, bad[:3]


@pytest.mark.parametrize("values,universe", [([], 0), ([0], 0), ([5], 5), ([1, 1, 1], 1), ([3, 900, 900, 5000], 5000)])
def test_elias_fano(values, universe):
    ef = boundaries.EliasFano.encode(np.array(values), universe)
    assert ef.all().tolist() == values == [ef.select(i) for i in range(len(values))]


def test_elias_fano_large_and_small():
    v = np.sort(np.random.default_rng(0).integers(0, 10 ** 6, 5000))
    ef = boundaries.EliasFano.encode(v, 10 ** 6)
    assert ef.all().tolist() == v.tolist()
    assert [ef.select(i) for i in range(0, 5000, 7)] == v[::7].tolist()
    assert 8 * (len(ef.low) + len(ef.high)) < 5000 * 11  # not 64


def test_token_files(spark, docs, rows, empty, tmp_path):
    path = vocabulary_path("byte_bpe_50k.json")
    boundaries.write_token_files(docs, str(tmp_path / "t"), path, segment_tokens=500, segment_docs=7)
    got = [tuple(r)[:4] for r in boundaries.read_token_files(spark, str(tmp_path / "t")).collect()]
    want, at = Counter(), 0
    by_start = {r[1]: r for r in got}
    assert len(by_start) == len(rows)
    order = [by_start[s][0] for s in sorted(by_start)]
    assert order == sorted((r[0] for r in rows), key=lambda i: (i is not None, i or 0))
    for s in sorted(by_start):
        assert s == at
        at += by_start[s][2]
    for i, t, *_ in rows:
        ids = ids_of(path, t, 2)
        want[(i, len(ids), crc(ids))] += 1
    assert Counter((d, n, c) for d, _, n, c in got) == want
    boundaries.write_token_files(empty, str(tmp_path / "e"), path)
    assert boundaries.read_token_files(spark, str(tmp_path / "e")).count() == 0


# ------------------------------------------------------------------ pseudonyms (2)

def luhn(d):
    return sum(x if i % 2 == 0 else (x * 2 % 10 + x // 5) for i, x in enumerate(map(int, reversed(d)))) % 10 == 0


def test_pseudonyms(spark, docs, empty):
    texts = ["card 4111111111111111, 4111 1111 1111 1111 and 4111-1111-1111-1111; not 4111111111111112",
             "again 4111111111111111", "born 1987-02-13 or 13/02/1987 or 02/13/1987, not 1987-02-30",
             "GB82 WEST 1234 5698 7654 32 or GB82WEST12345698765432, not GB83WEST12345698765432",
             "123-45-6789 not 666-45-6789", "10.0.0.1 not 10.0.0.256", "+1 (555) 123-4567", "a.7@mail.example.com", None, ""]
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    got = {r.doc_id: r for r in pseudonyms.pseudonymise(d, "key").collect()}
    cards = __import__("re").findall(r"(?:\d[ -]?){15}\d", got[0].text)
    plain = [c.replace(" ", "").replace("-", "") for c in cards]
    assert plain[0] == plain[1] == plain[2] != "4111111111111111" and luhn(plain[0])
    assert plain[3] == "4111111111111112" and got[0].n_values == 3
    assert got[1].text == "again " + plain[0]
    iso, dmy, mdy = got[2].text[5:15], got[2].text[19:29], got[2].text[33:43]
    assert iso == "-".join(reversed(dmy.split("/"))) and mdy.split("/")[::2] == [dmy[3:5], dmy[6:]]
    assert got[2].text.endswith("not 1987-02-30") and iso != "1987-02-13"
    a, b = got[3].text.split(", not ")
    x, y = a.split(" or ")
    assert x.replace(" ", "") == y != "GB82WEST12345698765432" and b == "GB83WEST12345698765432"
    assert int("".join(str(int(c, 36)) for c in y[4:] + y[:4])) % 97 == 1
    assert got[4].n_values == 1 and got[4].text.endswith("not 666-45-6789") and "123-45-6789" not in got[4].text
    assert got[5].n_values == 1 and got[5].text.endswith("10.0.0.256")
    assert got[6].kinds == ["phone"] and got[7].kinds == ["mail"]
    assert got[8].text is None and got[8].n_values == 0 and got[9].text == ""
    assert pseudonyms.pseudonymise(empty, "key").count() == 0
    out = pseudonyms.pseudonymise(docs, "key")
    assert out.columns == docs.columns + ["kinds", "n_values"]
    assert out.where("n_values = 0").select(docs.columns).exceptAll(docs).count() == 0


def test_pseudonyms_in_very_long_values(spark):
    texts = ["x@b" + ".c" * 10_000, "q@b.example " * 5_000, "word " * 20_000 + "4111111111111111",
             "a1B" * 350_000 + " x@b.example", "a@b.cc_d@e.ff", "1987-02-13_x@b.example"]
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    got = {r.doc_id: r for r in pseudonyms.pseudonymise(d, "key").collect()}
    assert got[0].n_values == 1 and got[0].text != texts[0] and got[0].text.endswith(".c" * 9_000)
    assert got[1].n_values == 5_000 and len(set(got[1].text.split())) == 1
    assert got[2].n_values == 1 and "4111111111111111" not in got[2].text
    assert got[3].n_values == 1 and got[3].text.startswith("a1B" * 350_000 + " ")  # a run of 1 MB is read once
    assert got[4].kinds == ["mail", "mail"] and got[5].kinds == ["mail"]  # the second begins where the first ends


def test_pseudonyms_inside_failing_runs(spark):
    """A value beside other digits is found, though the longest run is none."""
    texts = ["card 4111 1111 1111 1111 12/27", "4111111111111111 123", "415 555 1234 415 555 9876",
             "12 4111-1111-1111-1111 99", "212 555 1112 415 555 1234 650 555 9876 x", "GB82WEST12345698765432 PAID 12",
             "4111 1111 1111 1111", "1 2 3 4 5 6 7 8 9 1 2 3 4 5 7"]
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    got = {r.doc_id: r for r in pseudonyms.pseudonymise(d, "key").collect()}
    assert [got[i].kinds for i in range(7)] == [
        ["card"], ["card"], ["phone"] * 2, ["card"], ["phone"] * 3, ["iban"], ["card"]]
    card = got[6].text
    assert luhn(card.replace(" ", "")) and card != texts[6]
    assert got[0].text == f"card {card} 12/27" and got[1].text == card.replace(" ", "") + " 123"
    assert got[3].text == f"12 {card.replace(' ', '-')} 99" and got[5].text.endswith(" PAID 12")
    phones = [got[4].text[a:a + 12] for a in (0, 13, 26)]
    assert got[2].text.split() != texts[2].split() and got[4].text.endswith(" x")
    assert not set(phones) & {*(" ".join(texts[4].split()[a:a + 3]) for a in (0, 3, 6))}
    shape = __import__("re").compile("[0-9]")
    assert all(shape.sub("9", got[i].text) == shape.sub("9", t) for i, t in enumerate(texts) if i != 5)


def test_feistel_is_a_permutation(spark):
    d = spark.range(1000).select(F.lpad(F.col("id").cast("string"), 3, "0").alias("v"), "id")
    p = d.select(pseudonyms.feistel_text(F.col("v"), "k", F.lit("t")).alias("p"),
                 pseudonyms.feistel_pair(F.floor(F.col("id") / 50), F.col("id") % 50, 20, 50, "k", "t").alias("q"))
    assert p.select("p").distinct().count() == 1000 == p.select("q").distinct().count()
    assert p.where(~F.col("p").rlike("^[0-9]{3}$") | (F.col("q.a") >= 20) | (F.col("q.b") >= 50)).count() == 0


# ------------------------------------------------------------------ exact copies (3)

def norm(t):
    import re
    return re.sub(r"[\x20\x09-\x0D]+", " ", t or "")


@pytest.mark.parametrize("min_hot", [2, 256])
def test_exact_groups(docs, rows, empty, min_hot):
    got = [tuple(r) for r in contentsort.exact_groups(docs, min_hot=min_hot).collect()]
    groups = {}
    for i, t, *_ in rows:
        groups.setdefault(norm(t), []).append(i)
    want = Counter()
    for i, t, *_ in rows:
        g = groups[norm(t)]
        want[(i, min((x for x in g if x is not None), default=None), len(g), hashlib.sha256(norm(t).encode()).hexdigest())] += 1
    assert Counter((a, b, c, e) for a, b, c, _, e in got) == want
    kept = [r for r in got if r[3]]
    assert len(kept) == len(groups) and all(r[0] == r[1] for r in kept)
    assert contentsort.exact_groups(empty).count() == 0
    left = contentsort.drop_exact_copies(docs)
    assert left.columns == docs.columns and left.count() == len(groups)


# ------------------------------------------------------------------ WARC (4)

def test_warc_round_trip(spark, tmp_path):
    evil = "<p>\r\n\r\nWARC/1.0\r\nWARC-Type: response\r\n\r\n"
    html = ["<a>1</a>", "<a>1</a>", None, "", evil, "WARC/1.0\r\n", "end\r\n\r\n", "\r\n" * 9, "é" * 50_000, "<a>1</a>"]
    rows = [(i, None if i == 2 else f"http://x/{i}?a b", h, 1) for i, h in enumerate(html)]
    rows += [rows[3], rows[8], (None, "u", "<a>1</a>", 1)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, record int").repartition(3)
    for keep in (True, False):
        got = warc.round_trip(pages, payloads=keep)
        records = got.select("request.record_id").unionByName(got.select("answer.record_id"))
        assert records.distinct().count() == 2 * len(rows)
        got = Counter((r.page_id, r.answer.payload_bytes, r.answer.payload_digest, r.record_type, r.refers_to)
                      for r in got.collect())
        groups, want = {}, Counter()
        for i, _, h, _ in rows:
            groups.setdefault(h or "", []).append(i)
        for i, _, h, _ in rows:
            b, lead = (h or "").encode(), max(x for x in groups[h or ""] if x is not None)
            first = i == lead
            want[(i, len(b), base64.b32encode(hashlib.sha1(b).digest()).decode(),
                  "response" if first else "revisit", None if first else lead)] += 1
        assert got == want
    assert warc.round_trip(pages.limit(0)).count() == 0
    short = Counter((r.page_id, r.record_type) for r in warc.round_trip(pages, min_bytes=9).collect())
    assert short == Counter((i, "revisit" if len((h or "").encode()) >= 9 and i != max(groups[h]) else "response")
                            for i, _, h, _ in rows if h != "<a>1</a>") + Counter(
        (i, "response") for i, _, h, _ in rows if h == "<a>1</a>")


# ------------------------------------------------------------------ shards (5)

def jump_one(key, n):
    key &= (1 << 64) - 1
    b, j = -1, 0
    while j < n:
        b = j
        key = (key * 2862933555777941757 + 1) & ((1 << 64) - 1)
        j = int((b + 1) * (float(1 << 31) / ((key >> 33) + 1)))
    return b


def test_shards(docs, rows, empty):
    got = jumphash.assign_shards(docs, 24).collect()
    assert len(got) == len(rows)
    texts = Counter((i, len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for i, t, *_ in rows)
    assert Counter((r.doc_id, r["size"], r.text_crc32) for r in got) == texts
    slots = {}
    for r in got:
        key = jumphash.NULL_KEY if r.doc_id is None else r.doc_id
        assert (r.shard, r.grown_shard) == (jump_one(key, 24), jump_one(key, 25))
        assert r.grown_shard in (r.shard, 24)
        slots.setdefault(r.shard, []).append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert jumphash.assign_shards(empty, 24).count() == 0


# ------------------------------------------------------------------ near copies (6)

def shingle_set(t):
    w = (t or "").encode().lower().split()
    return {tuple(w[i:i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def brute_components(rows):
    sets = [(i, shingle_set(t)) for i, t, *_ in rows]
    root = list(range(len(sets)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x
    for a in range(len(sets)):
        for b in range(a):
            x, y = sets[a][1], sets[b][1]
            if x and y and 100 * len(x & y) >= 75 * len(x | y):
                root[find(a)] = find(b)
    least = {}
    for k, (i, s) in enumerate(sets):
        if i is not None:
            least[find(k)] = min(i, least.get(find(k), i))
    return Counter((i, len(s), least.get(find(k)) if s else i) for k, (i, s) in enumerate(sets))


@pytest.mark.parametrize("rounds", [(4, 64), (1,)])
def test_near_components(docs, rows, rounds):
    got = jaccardjoin.near_components(docs, rounds=rounds)
    assert Counter((r.doc_id, r.n_shingles, r.component_id) for r in got.collect()) == brute_components(rows)


def test_near_components_in_chains_and_crowds(spark):
    """Copies of copies drift from their origin; unrelated texts share long passages."""
    r = random.Random(4)
    vocab = [f"w{i}" for i in range(3000)]
    passage = [r.choice(vocab) for _ in range(60)]
    rows, i = [], 0
    for _ in range(6):
        w = [r.choice(vocab) for _ in range(70)]
        for _ in range(14):
            w = list(w)
            w[r.randrange(len(w))] = r.choice(vocab)
            rows.append((i, " ".join(w)))
            i += 1
    for _ in range(40):
        rows.append((i, " ".join(passage + [r.choice(vocab) for _ in range(r.choice([5, 12, 60]))])))
        i += 1
    d = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = jaccardjoin.near_components(d)
    assert Counter((x.doc_id, x.n_shingles, x.component_id) for x in got.collect()) == brute_components(rows)


def test_keep_one_per_group_with_null_and_repeated_ids(spark, rows, empty):
    apart = [" ".join(f"{a}{i}" for i in range(30)) for a in "abcdefg"]
    near = apart[0] + " edit"
    more = [(None, apart[1]), (None, apart[2]), (None, apart[2].upper()), (None, near), (500, apart[0]), (501, apart[3]), (501, apart[4]),
            (501, apart[4]), (502, apart[5]), (502, apart[5] + " edit"), (None, ""), (None, None), (None, ""), (501, " ")]
    table = rows + [(i, t, "en", "s", None, 1, 1, 1, 1) for i, t in more]
    out = jaccardjoin.keep_one_per_group(spark.createDataFrame(table, SCHEMA).repartition(5))
    got = Counter((r.doc_id, r.text) for r in out.collect())
    want, blank = [], set()
    for i, t, *_ in table:
        s = shingle_set(t)
        if not s:
            blank.add((i, t))
            continue
        linked = [g for g in want if any(100 * len(s & x) >= 75 * len(s | x) for _, _, x in g)]
        want = [g for g in want if g not in linked] + [sum(linked, [(i, t, s)])]
    assert Counter({k: n for k, n in got.items() if not shingle_set(k[1])}) == Counter(blank)
    left = [k for k in got.elements() if shingle_set(k[1])]
    assert len(left) == len(want)
    for g in want:  # one of each component, and of its smallest id
        least = min((i for i, *_ in g if i is not None), default=None)
        assert sum(k in left for k in {(i, t) for i, t, _ in g if i == least}) == 1
        assert not any(k in left for k in {(i, t) for i, t, _ in g if i != least})
    assert out.columns == SCHEMA.replace(" long", "").replace(" string", "").replace(" int", "").split(", ")
    assert jaccardjoin.keep_one_per_group(empty).count() == 0


def test_near_components_of_nothing(empty):
    assert jaccardjoin.near_components(empty).count() == 0


def test_word_hashes_of_long_texts():
    s = jaccardjoin.Shingler()
    words = [f"Word{i % 977}" for i in range(90_000)] + ["y" * 300_000, "end", "z" * 300_000]
    got = s.word_hashes(" ".join(words)).tolist()
    assert len(got) == len(words)
    names = {}
    for w, h in zip(words, got):
        assert names.setdefault(w, h) == h
    assert len(set(names.values())) == len(names)
    assert s.word_hashes("a word0 b")[1] == names["Word0"]
    thue = "".join("ab"[bin(i).count("1") % 2] for i in range(1024))  # equal to its complement under any 2^64 polynomial
    assert len(set(s.word_hashes(f"{thue} {thue.translate({97: 98, 98: 97})}").tolist())) == 2
    edge = "q" * jaccardjoin.PART  # a word hashed in a part of its own or with others
    assert s.word_hashes(edge + " tail")[0] == s.word_hashes(edge)[0]


# ------------------------------------------------------------------ toxicity (7)

def toxic_table(spark, n=400):
    r = random.Random(3)
    clean = ["table", "river", "window", "garden", "music", "paper", "stone"]
    bad = ["rotterish", "vilemonger", "scoundrelly"]
    rows, labels = [], []
    for i in range(n):
        y = i % 4 == 0
        w = [r.choice(clean) for _ in range(30)] + ([r.choice(bad) for _ in range(2)] if y else [])
        r.shuffle(w)
        rows.append((i, " ".join(w), 9.0, 1))
        labels.append((i, int(y)))
    rows += [(n, None, 9.0, 1), (n + 1, "", 9.0, 1), (None, "river rotterish", 9.0, 1), rows[0]]
    labels += [labels[0], (None, 1), (n + 5, None)]
    return (spark.createDataFrame(rows, "doc_id long, text string, score double, predicted int").repartition(3),
            spark.createDataFrame(labels, "doc_id long, toxic int"), rows, dict(labels[:n]))


def test_toxicity(spark):
    docs, labels, rows, truth = toxic_table(spark)
    index = toxicity.fit(docs, labels, k=5)
    out = toxicity.score_documents(docs, index)
    got = out.withColumn("held", toxicity.held_out(F.col("doc_id"))).collect()
    assert len(got) == len(rows) and out.columns == ["doc_id", "text", "score", "predicted", "evidence"]
    held = [r for r in got if r.held and r.doc_id in truth]
    assert len(held) > 40 and all(r.predicted == truth[r.doc_id] for r in held)
    assert all(0 <= r.score <= 1 and (r.predicted == 1) == (r.score >= 0.5) for r in got)
    assert all(r.predicted == 0 for r in got if not r.text)
    assert not any(zlib.crc32(str(i).encode()) % 5 == 0 for i in index.ids)
    for v in ({0: 1}, {0: 2, 1: 1}):  # the pruned search is the exhaustive one
        v = index.unit(v)
        places, cosines = index.nearest(v)
        dense = sum(w * index.lists[t].ravel() for t, w in v.items())
        best = np.sort(dense[dense > 0])[::-1][:index.k]
        assert np.allclose(cosines, best) and np.allclose(dense[places], cosines)


def test_toxicity_holds_little_in_a_worker(spark):
    """Terms and counts take the bytes they need, common terms have no posting lists beside their matrix,
    and terms are looked up in the sorted list itself."""
    for a in ([], [0], [255], [256, 1], [65536, 3], [2 ** 32 - 1, 0, 7]):
        raw = toxicity.packed(np.array(a, np.int64))
        assert toxicity.unpacked(raw).tolist() == a and len(raw) <= 1 + len(a) * max(1, -(-max(a, default=0).bit_length() // 8))
    docs, labels, rows, truth = toxic_table(spark)
    index = toxicity.fit(docs, labels, k=5)
    assert len(index.rare.weights) == int((index.common[index.terms] < 0).sum())
    assert index.terms.dtype == np.int32 and index.ids.tolist() == sorted(index.ids.tolist())
    terms = toxicity.TermMap(index.known)
    (got, times), (none, _) = terms.counts([rows[0][1], None])
    want = Counter(t for w in toxicity.text_words(rows[0][1]) for t in toxicity.word_terms(w))
    assert dict(zip(index.known[got].tolist(), times.tolist())) == {t: n for t, n in want.items() if t in set(index.known.tolist())}
    assert not len(none) and not any(isinstance(v, dict) for v in vars(terms).values())


def test_toxicity_looks_at_all_terms(spark):
    """Neighbours are those of the whole TF-IDF vectors: clean, rare and equally frequent terms, too."""
    docs, labels, rows, truth = toxic_table(spark, 120)
    more = [(1000 + i, f"calmly onlyhere{i % 3} été meadowland river", 9.0, 1) for i in range(30)]
    docs = docs.unionByName(spark.createDataFrame(more, docs.schema))
    labels = labels.unionByName(spark.createDataFrame([(r[0], r[0] % 2) for r in more], labels.schema))
    index = toxicity.fit(docs, labels, k=5)
    got = toxicity.score_documents(docs, index).collect()

    def terms(text):
        words = toxicity.LETTERS.findall((text or "").lower())
        return Counter(t for w in words for t in toxicity.word_terms(w))
    texts = [r[1] for r in rows + more]
    df = Counter(t for x in texts for t in terms(x))
    text_of = {r[0]: r[1] for r in rows + more}
    assert set(index.known.tolist()) == {t for i in index.ids.tolist() for t in terms(text_of[i])}

    known = set(index.known.tolist())

    def unit(text):
        v = {t: (1 + np.log(n)) * max(0.1, 1 + np.log(len(texts) / (1 + df[t])))
             for t, n in terms(text).items() if t in known}
        length = np.sqrt(sum(x * x for x in v.values()))
        return {t: x / length for t, x in v.items()}
    examples = {i: unit(text_of[i]) for i in index.ids.tolist()}
    for r in got:
        v = unit(r.text)
        cos = [(-round(sum(w * e.get(t, 0.0) for t, w in v.items()), 9), i) for i, e in examples.items() if i != r.doc_id]
        want = sorted(c for c in cos if c[0] < 0)[:5]
        assert [(-round(e.cosine, 9), e.doc_id) for e in r.evidence] == want
    assert all(r.evidence for r in got if r.text)


def test_an_example_has_one_text_and_not_itself_as_neighbour(spark):
    rows = [(i, f"same words {'bad' if i % 2 else 'fine'} {i % 7}") for i in range(60)]
    docs = spark.createDataFrame(rows + [(1, "zz another text"), (2, None)], "doc_id long, text string").repartition(6)
    labels = spark.createDataFrame([(i, i % 2) for i in range(60)], "doc_id long, toxic int")
    got = [toxicity.score_documents(docs, toxicity.fit(docs, labels)).orderBy("doc_id", "text").collect() for _ in "ab"]
    assert got[0] == got[1]
    assert all(e.doc_id != r.doc_id for r in got[0] for e in r.evidence) and got[0][0].evidence


def test_toxicity_without_labels(spark, empty):
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert toxicity.fit(empty, none) is None
    docs, labels, *_ = toxic_table(spark, 20)
    got = toxicity.score_documents(docs, toxicity.fit(docs, none)).collect()
    assert {r.score for r in got} == {0.0} and toxicity.score_documents(empty, None).count() == 0


# ------------------------------------------------------------------ packing (8)

def test_hilbert_is_a_curve():
    bits, n = 3, 8
    pts = np.stack(np.meshgrid(*[np.arange(n)] * 3, indexing="ij"), -1).reshape(-1, 3)
    keys = hilbert.hilbert_keys(pts, bits)
    assert sorted(keys.tolist()) == list(range(n ** 3))
    walk = pts[np.argsort(keys)]
    assert (np.abs(np.diff(walk, axis=0)).sum(1) == 1).all()


def test_packing(docs, rows, empty):
    path, length = vocabulary_path("word_bpe_49k.json"), 64
    got = hilbert.pack(docs, path, length=length, keep_ids=True).collect()
    want = Counter()
    for i, t, *_ in rows:
        ids = ids_of(path, t, 1)
        want[(i, len(ids), crc(ids))] += 1
    seqs = {}
    for r in got:
        seqs.setdefault(r.sequence_id, []).append(r)
        assert r.ids_crc32 == crc(np.frombuffer(r.ids, "<u2")) and len(r.ids) == 2 * r.length
    assert sorted(seqs) == list(range(len(seqs)))
    for k, s in seqs.items():
        s.sort(key=lambda r: r.offset)
        assert [r.offset for r in s] == [0, *np.cumsum([r.length for r in s])[:-1]]
        size = sum(r.length for r in s)
        assert size == length or (size < length and size & (size - 1) == 0)
    # every document can be put together again from its pieces, in stream order
    stream = [r for k in sorted(seqs) for r in seqs[k]]
    have, part = Counter(), []
    for r in stream:
        part.append(r)
        if r.start + r.length == r.doc_tokens:
            assert [x.start for x in part] == [0, *np.cumsum([x.length for x in part])[:-1]]
            have[(r.doc_id, r.doc_tokens, crc(np.frombuffer(b"".join(x.ids for x in part), "<u2")))] += 1
            part = []
    assert have == want and not part
    keys = [r.curve_key for r in stream]
    assert keys == sorted(keys)
    assert hilbert.pack(empty, path).count() == 0


# ------------------------------------------------------------------ nearest neighbours (9)

def test_nearest_with_ties_and_bad_vectors(spark):
    rng = np.random.default_rng(2)
    x = rng.standard_normal((700, 16)).round(2)
    x[100:160] = x[7]
    rows = [(i, v.tolist(), "c") for i, v in enumerate(x)]
    rows += [(800, None, "c"), (900, [0.0] * 16, "c"), (1000, [float("nan")] * 16, "c"), (1100, [None] + [1.0] * 15, "c"),
             (1200, [float("inf")] + [1.0] * 15, "c"), (1300, [1.0, 2.0], "c"), (1400, [2.0, 2.0], "c"), (1500, [], "c"),
             rows[0]]
    d = spark.createDataFrame(rows, "vec_id long, embedding array<float>, codes string").repartition(4)
    index, centres = onebit.build_index(d)
    got = {}
    for r in onebit.search(index, centres, d.where("vec_id % 100 = 0")).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    xs = x.astype(np.float32).astype(np.float64)
    for q in range(0, 700, 100):
        dist = np.sqrt(((xs - xs[q]) ** 2).sum(1))
        cand = [(dist[i], i) for i in range(700) if i != q] + [(dist[0], 0)] * (q != 0)
        want = sorted(cand)[:10]
        mine = sorted(got[q])[:20:2] if q == 0 else sorted(got[q])  # query 0 is there twice
        assert [m[1] for m in mine] == [w[1] for w in want]
        assert np.allclose([m[2] for m in mine], [w[0] for w in want])
    assert got[1300] == [(1, 1400, 1.0)] and set(got) == {*range(0, 700, 100), 1300, 1400}
    index, centres = onebit.build_index(d.limit(0))
    assert onebit.search(index, centres, d.limit(0)).count() == 0


# ------------------------------------------------------------------ mixing (10)

def brute_targets(sizes, share=1.5, weights=(3, 1, 2)):
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: weights[k % 3] for k, s in enumerate(names)}
    target, open_, left = {}, set(names), share * sum(sizes.values())
    while open_:
        total = sum(w[s] for s in open_)
        over = {s for s in open_ if left * w[s] / total > 2 * sizes[s]}
        if not over:
            target |= {s: left * w[s] / total for s in open_}
            break
        for s in over:
            target[s] = 2.0 * sizes[s]
        left -= sum(target[s] for s in over)
        open_ -= over
    return target


def test_fair_mix(docs, rows, empty):
    got = fairmix.fair_mix(docs).collect()
    size = {}
    for i, t, _, s, *_ in rows:
        size[s] = size.get(s, 0) + len((t or "").encode().split())
    target = brute_targets(size)
    assert len(got) == len(rows)
    taken = Counter()
    for r in got:
        assert 0 <= r.taken <= 2 * r["size"] and r.source_size == size[r.source]
        assert r.target == pytest.approx(target[r.source])
        taken[r.source] += r.taken
    for s in size:
        assert abs(taken[s] - target[s]) <= 1
    assert sum(taken.values()) <= 1.5 * sum(size.values())
    line = sorted((r.mix_start, r.finish) for r in got if r.mix_start is not None)
    assert [f for _, f in line] == sorted(f for _, f in line)
    again = fairmix.fair_mix(docs.repartition(3)).collect()
    assert Counter(map(tuple, again)) == Counter(map(tuple, got))
    assert fairmix.fair_mix(empty).count() == 0
    drawn = fairmix.draw_mix(docs)
    assert drawn.columns == docs.columns
    assert drawn.count() == sum(int(r.taken / r["size"] + 0.5) for r in got if r["size"])


def test_targets_where_several_sources_are_short(spark):
    for sizes in ({"a": 10, "b": 1000, "c": 30, "d": 5, "e": 700}, {"a": 0, "b": 3, None: 9}, {"z": 7}):
        d = spark.createDataFrame(list(sizes.items()), "source string, source_size long")
        got = {r.source: r.target for r in fairmix.source_targets(d).collect()}
        assert got == pytest.approx(brute_targets(sizes))
