"""Toxicity by nearest labelled examples.

Labelled examples and documents are TF-IDF vectors over terms: words, and the
first five and six letters of longer words. Every term of the examples counts,
none is selected; terms that no example has can meet nothing and are left out.
Texts are split once: each document's terms and counts are written down, and both
the document frequencies over the whole corpus and the scores are made of them.
A document's ``k`` nearest examples by cosine are found exactly through an inverted
index. A screen in float32 comes first: posting lists of the rarer terms are summed,
those of the ``COMMON`` commonest are a matrix that ``BATCH`` documents are
multiplied with at a time. What may be among the nearest is then computed in
float64 from the examples' vectors (bounds of blocks
of examples left 60 % of the blocks open on whole vectors, and opening them one
document at a time took ten times as long). A labelled example that is scored is
not its own neighbour. Neighbours vote with weight
``1 / (distance + 0.05)``; a logistic curve fitted to leave-one-out votes of the
examples calibrates the vote to the share of toxic labels.

Bounds: at most ``max_examples`` labelled rows of each class (by a hash of the
id) fit the model, a parameter; the index and the terms of these examples (64-bit
hashes of them) are the only things broadcast. Counts and scores cover every document and whole
texts.
"""

from __future__ import annotations

import functools
import re
from array import array
from collections import Counter
from itertools import chain

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from xxhash import xxh3_64_intdigest

from kindred.llm.common import stage, whole_text

HALF = 1 << 63
LETTERS = re.compile(r"[^\W\d_]+")
PREFIXES = (5, 6)
BATCH = 64  # documents looked up at a time
COMMON = 1024  # terms whose posting lists are columns of a matrix
READ = "__terms_of_text"  # column of a document's terms and counts
READ_TYPE = "terms binary, counts binary"
NO_LETTERS = {c: " " for c in range(128) if not chr(c).isalpha()}


def word_terms(word: str) -> tuple:
    """Terms of a word as signed 64-bit hashes."""
    own, n = xxh3_64_intdigest(word) - HALF, len(word)
    if n <= PREFIXES[0]:
        return (own,)
    return (own, *[xxh3_64_intdigest(word[:k] + "-") - HALF for k in PREFIXES if n > k])


def text_words(text) -> list:
    text = (text or "").lower()
    return text.translate(NO_LETTERS).split() if text.isascii() else LETTERS.findall(text)


def ranges(starts, sizes):
    """``starts[0], starts[0] + 1, ...`` up to each size, one range after the other."""
    ends = np.cumsum(sizes)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - ends + sizes, sizes)


class TermMap(dict):
    """Numbers (places in ``known``) of the terms of texts, each distinct word looked up once.

    Maps the words met to rows of a list of term numbers: about ``MEMO`` words at a
    time. Sent to another process, it starts without words.
    """
    MEMO = 200_000

    def __init__(self, known: np.ndarray):
        super().__init__()
        self.known = known
        self.forget()

    def __reduce__(self):
        return TermMap, (self.known,)

    def forget(self):
        self.clear()
        self.starts, self.flat = array("q", [0]), array("i")

    def learn(self, words) -> None:
        """Rows for ``words``, none of which has one; their terms are looked up together."""
        terms = [word_terms(w) for w in words]
        sizes = np.fromiter(map(len, terms), np.int64, len(terms))
        flat = np.fromiter(chain.from_iterable(terms), np.int64, int(sizes.sum()))
        at = np.searchsorted(self.known, flat)
        met = self.known[np.minimum(at, len(self.known) - 1)] == flat if len(self.known) else np.zeros(len(flat), bool)
        ends = np.append(0, np.cumsum(met))[np.cumsum(sizes)] + len(self.flat)
        self.update(zip(words, range(len(self), len(self) + len(words))))
        self.flat.frombytes(at[met].astype(np.int32).tobytes())
        self.starts.frombytes(ends.astype(np.int64).tobytes())

    def counts(self, texts) -> list:
        """``(terms, counts)`` of each text, terms ascending."""
        if len(self) > self.MEMO:
            self.forget()
        words = [Counter(text_words(t)) for t in texts]
        self.learn(list(set().union(*words).difference(self)))
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        total = int(sizes.sum())
        rows = np.fromiter(map(self.__getitem__, chain.from_iterable(words)), np.int64, total)
        times = np.fromiter(chain.from_iterable(c.values() for c in words), np.int64, total)
        starts, flat = np.frombuffer(self.starts, np.int64), np.frombuffer(self.flat, np.int32)
        n = starts[rows + 1] - starts[rows]
        # One key a text and term; repeated ones (of several words) are added up.
        keys = np.repeat(np.repeat(np.arange(len(words)), sizes) * len(self.known), n) + flat[ranges(starts[rows], n)]
        del starts, flat  # the arrays can grow again
        order = np.argsort(keys)
        keys, times = keys[order], np.repeat(times, n)[order]
        first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])) if len(keys) else np.empty(0, np.int64)
        sums = np.add.reduceat(times, first) if len(keys) else times
        text, terms = np.divmod(keys[first], max(1, len(self.known)))
        at = np.searchsorted(text, np.arange(len(words) + 1)).tolist()
        return [(terms[a:b], sums[a:b]) for a, b in zip(at, at[1:])]


def packed(numbers) -> bytes:
    """Numbers below 2**32 as bytes: how many bytes each takes, then their lowest bytes first, the highest last."""
    width = max(1, (int(numbers.max(initial=0)).bit_length() + 7) // 8)
    return bytes([width]) + numbers.astype("<u4").view(np.uint8).reshape(-1, 4)[:, :width].T.tobytes()


def unpacked(raw: bytes):
    columns = np.frombuffer(raw, np.uint8, offset=1).reshape(raw[0], -1)
    got = np.zeros((columns.shape[1], 4), np.uint8)
    got[:, :raw[0]] = columns.T
    return got.view("<u4").ravel().astype(np.int64)


def read_terms(texts, terms: TermMap) -> list:
    """Packed terms (as differences) and counts of each of ``texts``, each distinct text read once."""
    got, new = {}, list(dict.fromkeys(texts))
    for at in range(0, len(new), BATCH):
        some = new[at:at + BATCH]
        got.update(zip(some, [(packed(np.diff(t, prepend=0)), packed(n)) for t, n in terms.counts(some)]))
    return [got[t] for t in texts]


class Postings:
    """Weights by term: ``[t]`` is the row of term ``t`` over all places."""

    def __init__(self, terms, places, weights, n_terms: int, n_places: int):
        order = np.argsort(terms, kind="stable").astype(np.int32)  # places ascend
        self.places, self.weights = places[order], weights.astype(np.float32)[order]
        self.starts = np.append(0, np.cumsum(np.bincount(terms, minlength=n_terms)))
        self.n_places = n_places

    def __getitem__(self, t):
        row, part = np.zeros(self.n_places), slice(self.starts[t], self.starts[t + 1])
        row[self.places[part]] = self.weights[part]
        return row

    def sums(self, terms, weights):
        """Sum over ``terms`` of their rows times ``weights``."""
        starts = self.starts[terms]
        sizes = self.starts[terms + 1] - starts
        at = ranges(starts, sizes)
        got = self.weights.take(at)
        got *= np.repeat(weights.astype(np.float32), sizes)
        return np.bincount(self.places.take(at), got, minlength=self.n_places)


class Index:
    """Inverted index of the examples' unit TF-IDF vectors; their ``ids`` ascend.

    ``vectors`` gives ``(terms, weights)`` arrays, one pair an example, and is gone through once.
    They are what the index holds; postings and matrix are made where it is used.
    """

    def __init__(self, ids, labels, vectors, idf, k: int):
        self.ids, self.labels = np.array(ids, np.int64), np.array(labels, np.int8)
        self.idf, self.k = idf, k
        terms, weights, starts = array("i"), array("d"), array("q", [0])
        for t, w in vectors:
            terms.frombytes(t.astype(np.int32).tobytes())
            weights.frombytes(w.astype(np.float64).tobytes())
            starts.append(len(terms))
        self.terms, self.weights, self.starts = np.array(terms, np.int32), np.array(weights), np.array(starts, np.int64)
        self.columns = np.argsort(-np.bincount(self.terms, minlength=len(idf)), kind="stable")[:COMMON]
        self.common = np.full(len(idf), -1, np.int32)  # column among the common terms
        self.common[self.columns] = np.arange(len(self.columns))
        self.class_weight = np.ones(2)
        self.curve, self.blank, self.prior = (1.0, 0.0), 0.0, 0.0

    def __getstate__(self):
        return {k: v for k, v in vars(self).items() if k not in ("lists", "rare", "rows32", "term_map", "scratch", "held")}

    def _places(self):
        """Place of each of ``terms``."""
        return np.repeat(np.arange(len(self.ids), dtype=np.int32), np.diff(self.starts))

    @functools.cached_property
    def lists(self):
        return Postings(self.terms, self._places(), self.weights, len(self.idf), len(self.ids))

    @functools.cached_property
    def rare(self):
        """Posting lists without those of the common terms, which ``rows32`` has."""
        held = self.common[self.terms] < 0
        return Postings(self.terms[held], self._places()[held], self.weights[held], len(self.idf), len(self.ids))

    @functools.cached_property
    def rows32(self):
        """Weights of the common terms, an example a row."""
        rows = np.zeros((len(self.ids), len(self.columns)), np.float32)
        column = self.common[self.terms]
        held = column >= 0
        rows[self._places()[held], column[held]] = self.weights[held]
        return rows

    @functools.cached_property
    def term_map(self):
        return TermMap(self.known)

    @functools.cached_property
    def scratch(self):
        return np.zeros(len(self.idf))

    def cosines(self, places, terms, weights):
        """Cosines of the vector with the examples at ``places``."""
        self.scratch[terms] = weights
        got = [self.scratch.take(t) @ w for t, w in map(self.vector, places)]
        self.scratch[terms] = 0.0
        return np.array(got, float)

    def vector(self, place: int):
        part = slice(self.starts[place], self.starts[place + 1])
        return self.terms[part], self.weights[part]

    def weigh(self, terms, counts):
        """``terms`` and the weights of the unit vector."""
        v = (1 + np.log(counts)) * self.idf[terms]
        length = np.sqrt((v * v).sum())
        return (terms, v / length) if length > 0 else (terms[:0], v[:0])

    def unit(self, counts: dict) -> dict:
        terms, weights = self.weigh(np.array(list(counts), np.int64), np.array(list(counts.values()), float))
        return dict(zip(terms.tolist(), weights.tolist()))

    def nearest(self, v: dict):
        """``(places, cosines)`` of the ``k`` best, exactly; of equal cosines the smaller ids."""
        return next(self.nearest_each([(np.array(list(v), np.int64), np.array(list(v.values()), float))]))

    def nearest_each(self, vectors, skip=None):
        """``nearest`` of each of ``(terms, weights)``; ``skip`` has a place to leave out for each, or -1.

        No weight is negative and vectors have length 1, so a float32 sum of ``COMMON``
        products is off by less than 1e-4.
        """
        for at in range(0, len(vectors), BATCH):
            some = vectors[at:at + BATCH]
            common = np.zeros((len(some), len(self.columns)), np.float32)
            rare = []
            for row, (terms, weights) in zip(common, some):
                c = self.common[terms]
                held = c >= 0
                row[c[held]] = weights[held]
                rare.append((terms[~held], weights[~held]))
            screen = common @ self.rows32.T
            for i, (terms, weights) in enumerate(some):
                row = self.rare.sums(*rare[i]) + screen[i]
                if skip is not None and skip[at + i] >= 0:
                    row[skip[at + i]] = 0.0
                floor = np.partition(row, -self.k)[-self.k] - 2e-4 if len(row) > self.k else 0.0
                places = np.flatnonzero(row > max(floor, 0.0))
                exact = self.cosines(places, terms, weights)
                # Equal to 12 places is equal: by place then.
                best = np.argsort(-np.round(exact, 12), kind="stable")[:self.k]
                yield places[best], exact[best]

    def vote(self, places, cosines) -> float:
        """Share of the distance-weighted votes that is toxic, pulled to the prior by a small weight."""
        y = self.labels[places]
        w = self.class_weight[y] / (1.05 - np.minimum(cosines, 1.0))
        return float((w[y == 1].sum() + self.prior) / (w.sum() + 1.0))

    def own_votes(self, places) -> list:
        """Vote of all other examples on those at ``places``; None where no other is near."""
        return [self.vote(*near) if len(near[0]) else None
                for near in self.nearest_each([self.vector(p) for p in places], places)]

    def calibrate(self, own: list) -> None:
        """Fits curve and blank score to ``own``, the votes on all examples by place."""
        met = np.array([v is not None for v in own], bool)
        y, w = self.labels[~met], self.class_weight[self.labels]
        self.blank = float(((w[~met] * y).sum() + self.prior) / (w[~met].sum() + 1.0))
        votes, ys = np.array([v for v in own if v is not None], float), self.labels[met]
        self.curve = _logistic(_logit(votes), ys.astype(float), w[met]) if len(set(ys.tolist())) == 2 else (1.0, 0.0)

    def scores(self, counts: list, skip, curve, blank):
        """``(score, places, cosines)`` of each of ``(terms, counts)``, without the place in ``skip``."""
        a, b = curve
        for near in self.nearest_each([self.weigh(*c) for c in counts], skip):
            score = 1 / (1 + np.exp(-(a * _logit(self.vote(*near)) + b))) if len(near[0]) else blank
            yield float(score), *near


def _logit(p):
    p = np.clip(p, 0.005, 0.995)
    return np.log(p / (1 - p))


def _logistic(x, y, w, rounds: int = 50, ridge: float = 1e-2):
    """Slope and offset of a weighted logistic fit (Newton steps, small ridge; slope stays positive)."""
    a, b = 1.0, 0.0
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-(a * x + b)))
        g = np.array([(w * (p - y) * x).sum() + ridge * (a - 1), (w * (p - y)).sum() + ridge * b])
        s = w * p * (1 - p)
        h = np.array([[(s * x * x).sum() + ridge, (s * x).sum()], [(s * x).sum(), s.sum() + ridge]])
        step = np.linalg.solve(h, g)
        a, b = a - float(np.clip(step[0], -1, 1)), b - float(np.clip(step[1], -1, 1))
        if np.abs(step).max() < 1e-9:
            break
    return max(a, 0.05), b


def held_out(doc_id):
    """Rows that never train: crc32 of the id's text divisible by 5 (null ids too)."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(True))


def fit(docs: DataFrame, labels: DataFrame, **parameters) -> Index | None:
    """The index of ``fit_and_read``."""
    return fit_and_read(docs, labels, **parameters)[0]


def fit_and_read(docs: DataFrame, labels: DataFrame, label_col: str = "toxic", k: int = 15,
                 max_examples: int = 3000, seed: int = 3, text_kept: bool = False) -> tuple[Index | None, DataFrame]:
    """The index of labelled examples (None where no labelled text can be used), and ``docs``
    (without the text, unless it is to be kept) with the terms of each text, for ``score_read``.

    Repeated labels of an id count as toxic if one does; null labels don't count.
    Of an example id with several texts, the first in order is taken.
    """
    lab = labels.where(F.col("doc_id").isNotNull() & F.col(label_col).isNotNull()) \
        .where(~held_out(F.col("doc_id"))).groupBy(F.col("doc_id").alias("ex_id")) \
        .agg(F.max((F.col(label_col) == 1).cast("int")).alias("y"))
    lab = stage(lab, "toxic-labels")
    totals = {r["y"]: r["n"] for r in lab.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    by_hash = [F.xxhash64("ex_id", F.lit(seed)), F.col("ex_id")]
    drawn = lab.where("y = 1").orderBy(*by_hash).limit(max_examples) \
        .unionByName(lab.where("y = 0").orderBy(*by_hash).limit(max_examples))
    drawn = stage(drawn, "toxic-drawn")  # at most 2 * max_examples rows of id and label
    ex = docs.select(F.col("doc_id").alias("ex_id"), whole_text().alias("text")) \
        .join(F.broadcast(drawn), "ex_id").groupBy("ex_id").agg(F.min("text").alias("text"), F.first("y").alias("y"))
    ex = stage(ex, "toxic-examples")

    def example_terms(frames):
        import pandas as pd
        for frame in frames:
            words = {w for text in frame["text"] for w in text_words(text)}
            yield pd.DataFrame({"term": list({t for w in words for t in word_terms(w)})}, dtype="int64")

    n = {r["y"]: r["n"] for r in ex.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    plain = docs if text_kept else docs.drop("text")
    if len(n) < 2:
        return None, plain
    # Every term of at most 2 * max_examples texts.
    known = np.sort(ex.mapInPandas(example_terms, "term long").distinct().toPandas()["term"].to_numpy())
    if not len(known):
        return None, plain
    sc = docs.sparkSession.sparkContext
    held = sc.broadcast(TermMap(known))

    @F.pandas_udf(READ_TYPE)
    def read_texts(texts):
        import pandas as pd
        return pd.DataFrame(read_terms(texts.tolist(), held.value), columns=["terms", "counts"])

    read = docs.withColumn(READ, read_texts(whole_text()))
    read = stage(read if text_kept else read.drop("text"), "toxic-terms")
    n_terms = len(known)

    def frequencies(frames):
        import pandas as pd
        rows, df = 0, np.zeros(n_terms, np.int64)
        for frame in frames:
            rows += len(frame)
            for raw in frame["terms"]:
                df[np.cumsum(unpacked(raw))] += 1
        some = np.flatnonzero(df)
        yield pd.DataFrame({"term": np.append(some, -1), "n": np.append(df[some], rows)})

    got = read.select(f"{READ}.terms").mapInPandas(frequencies, "term int, n long") \
        .groupBy("term").agg(F.sum("n").alias("n")).toPandas()
    df = np.zeros(len(known) + 1, np.int64)
    df[got["term"]] = got["n"]  # -1, the last one: rows
    idf = (1 + np.log(max(1, df[-1]) / (1 + df[:-1]))).clip(0.1)

    examples = ex.select("ex_id", "y", read_texts("text").alias("r")).select("ex_id", "y", "r.*") \
        .toPandas().sort_values("ex_id")  # at most 2 * max_examples rows
    shell = Index([], [], [], idf, k)
    index = Index(examples["ex_id"].tolist(), examples["y"].tolist(),
                  (shell.weigh(np.cumsum(unpacked(t)), unpacked(c))
                   for t, c in zip(examples["terms"], examples["counts"])), idf, k)
    held.destroy()
    del examples, got
    index.known = known
    index.class_weight = np.array([totals.get(y, 0) / max(1, n[y]) for y in (0, 1)])
    index.class_weight /= index.class_weight.max()
    index.prior = totals.get(1, 0) / sum(totals.values())
    index.held = shared = sc.broadcast(index)

    def own_votes(frames):
        import pandas as pd
        for frame in frames:
            places = frame["id"].to_numpy()
            yield pd.DataFrame({"place": places, "vote": pd.array(shared.value.own_votes(places), "Float64")})

    parts = max(1, min(sc.defaultParallelism, len(index.ids) // 100))
    own = docs.sparkSession.range(0, len(index.ids), 1, parts).mapInPandas(own_votes, "place long, vote double").collect()
    index.calibrate([r["vote"] for r in sorted(own)])
    return index, read


def score_documents(docs: DataFrame, index: Index | None, evidence: bool = True,
                    id_col: str = "doc_id") -> DataFrame:
    """``docs`` plus ``score, predicted`` and ``evidence`` (nearest examples:
    id, label, cosine; never the row's own id). Column names of ``docs`` don't matter but ``text``; the
    new ones replace any of the same name.

    Null or empty texts, and texts without a term of an example, score the share of
    toxic labels among examples without one. Without an index every score is 0.
    """
    if index is None:
        return score_read(docs, None, evidence, id_col)
    held = index.held

    @F.pandas_udf(READ_TYPE)
    def read_texts(texts):
        import pandas as pd
        return pd.DataFrame(read_terms(texts.tolist(), held.value.term_map), columns=["terms", "counts"])

    return score_read(docs.withColumn(READ, read_texts(whole_text())), index, evidence, id_col)


def score_read(read: DataFrame, index: Index | None, evidence: bool = True, id_col: str = "doc_id") -> DataFrame:
    """``score_documents`` of rows whose texts ``fit_and_read`` has read."""
    kind = "array<struct<doc_id:long,label:int,cosine:double>>"
    if index is None:
        new = {"score": F.lit(0.0), "predicted": F.lit(0)}
        return read.withColumns(new | ({"evidence": F.array().cast(kind)} if evidence else {}))
    held, curve, blank = index.held, index.curve, index.blank

    @F.pandas_udf(f"score double, evidence {kind}")
    def score(ids, read):
        import pandas as pd
        ix, got = held.value, {}
        at = np.searchsorted(ix.ids, ids.fillna(-1).astype("int64"))
        own = np.where((ix.ids[np.minimum(at, len(ix.ids) - 1)] == ids.fillna(-1)) & ids.notna(), at, -1).tolist()
        rows = list(zip(read["terms"], read["counts"], own))
        new = list(dict.fromkeys(rows))
        for at in range(0, len(new), BATCH):
            some = new[at:at + BATCH]
            scored = ix.scores([(np.cumsum(unpacked(t)), unpacked(c)) for t, c, _ in some],
                               [place for *_, place in some], curve, blank)
            for row, (s, places, cosines) in zip(some, scored):
                got[row] = (s, [{"doc_id": i, "label": y, "cosine": c} for i, y, c in zip(
                    ix.ids[places].tolist(), ix.labels[places].tolist(), cosines.tolist())] if evidence else [])
        return pd.DataFrame({"score": [got[r][0] for r in rows], "evidence": [got[r][1] for r in rows]})

    out = read.withColumn("__s", score(F.col(id_col).cast("long"), F.col(READ)))
    new = {"score": F.col("__s.score"), "predicted": (F.col("__s.score") >= 0.5).cast("int")}
    if evidence:
        new["evidence"] = F.col("__s.evidence")
    return out.withColumns(new).drop("__s", READ)
