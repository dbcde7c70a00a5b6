"""Phrase collocations from count streams in prefix and suffix order.

Counting: each task cuts its texts into pieces and words, numbers the words of
a block and counts its phrases by sorting number tuples, so a block leaves as
sorted, distinct phrases with counts; Spark adds the counts up. Phrases of three words
leave only where both of their two-word phrases may be frequent (a bit array of
fixed size; it can let too many through, never too few).

Joining: the frequent phrases of all orders are one stream. In *prefix order*
(first word first, shorter phrases before their extensions) a phrase's own
beginnings are the last shorter phrases passed, so one walk gives each phrase the
counts of its beginnings, and tells which phrases a right extension covers.
In *suffix order* (last word first) the same walk gives the counts of its
endings and the left extensions. Nothing is looked up by hash. The stream
is range-sorted over many partitions; a partition starts with the last shorter phrases
of the ones before it, which are at most two rows a partition.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kindred.llm.common import stage, whole_text
from kindred.operators.sampling import top_n_per_group
from kindred.session import cut_lineage

# Fixed by the contract: separators of pieces, of words, and the lower-casing.
PIECE_ENDS = b".,;:!?\n\x0b\x0c\r"
_UPPER = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"
TABLE = bytes.maketrans(PIECE_ENDS + _UPPER, b"\n" * len(PIECE_ENDS) + _UPPER.lower())

BLOCK_BYTES = 8 << 20    # text counted at once in a task
FILTER_BITS = 1 << 26    # bits of the frequent-pair filter, whatever the corpus
FILTER_ROWS = 64         # rows the filter is collected in
COUNTS = "lang string, w1 string, w2 string, w3 string, cnt long"


def _blocks(batches):
    """``(lang, words, numbers)`` of text blocks: distinct words and, for the
    running text, each word's number, -1 after every piece."""
    held, size = {}, 0
    for batch in batches:
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            held.setdefault(lang, []).append(text)
            size += len(text)
            if size >= BLOCK_BYTES:
                for item in held.items():
                    yield _numbered(*item)
                held, size = {}, 0
    for item in held.items():
        yield _numbered(*item)


def _numbered(lang, texts):
    number = {}
    give, out = number.setdefault, []
    for text in texts:
        for piece in text.translate(TABLE).split(b"\n"):
            words = piece.split()  # spaces and tabs; the other blanks end pieces
            if words:
                out += [give(w, len(number)) for w in words]
                out.append(-1)
    return lang, list(number), np.array(out, np.int64)


def _counted(keys):
    """Distinct keys in order with their counts, by sorting."""
    keys = np.sort(keys)
    first = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))[:len(keys)]
    return keys[first], np.diff(np.concatenate((first, [len(keys)])))


def _mix(h):
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def _word_hashes(words, lang: str):
    """Only for the filter; equal phrases have equal hashes, which is all it needs."""
    import xxhash
    seed = xxhash.xxh3_64_intdigest(lang.encode())
    return np.array([xxhash.xxh3_64_intdigest(w, seed) for w in words], np.uint64)


def _pair_bits(left, right):
    """The two filter bits of each word pair."""
    h = _mix(left * np.uint64(3) + right)
    return [(h >> np.uint64(s)).astype(np.int64) % FILTER_BITS for s in (0, 32)]


def _rows(lang, words, columns, counts):
    import pyarrow as pa
    table, n = pa.array(words, pa.binary()), len(counts)
    for a in range(0, n, 32_768):
        size = min(32_768, n - a)
        cols = [pa.array([lang], pa.string()).take(pa.array(np.zeros(size, np.int32)))]
        cols += [table.take(pa.array(c[a:a + size])).cast(pa.string()) for c in columns]
        cols += [pa.nulls(size, pa.string())] * (3 - len(columns))
        yield pa.RecordBatch.from_arrays([*cols, pa.array(counts[a:a + size].astype(np.int64))],
                                         names=["lang", "w1", "w2", "w3", "cnt"])


def _words_and_pairs(batches):
    """Counts of words and pairs, and a row without words for all words of a block."""
    for lang, words, x in _blocks(batches):
        k, n = _counted(x[x >= 0])
        yield from _rows(lang, words, [], n.sum(keepdims=True))
        yield from _rows(lang, words, [k], n)
        if len(x) > 1:
            a, b = x[:-1], x[1:]
            k, n = _counted(((a << 32) | b)[(a >= 0) & (b >= 0)])
            yield from _rows(lang, words, [k >> 32, k & 0xFFFFFFFF], n)


def _triples(batches, bits):
    for lang, words, x in _blocks(batches):
        if len(x) < 3:
            continue
        h = _word_hashes(words, lang)
        inside = (x[:-1] >= 0) & (x[1:] >= 0)
        pairs, place = np.unique(((x[:-1] << 32) | x[1:])[inside], return_inverse=True)
        p = np.full(len(x) - 1, -1)
        p[inside] = place
        may = np.concatenate((_test(bits, h[pairs >> 32], h[pairs & 0xFFFFFFFF]), [False]))[p]
        both = may[:-1] & may[1:]
        k, n = _counted((p[:-1][both] << 32) | x[2:][both])
        pair = pairs[k >> 32]
        yield from _rows(lang, words, [pair >> 32, pair & 0xFFFFFFFF, k & 0xFFFFFFFF], n)


def _test(bits, left, right):
    ok = np.ones(len(left), bool)
    for at in _pair_bits(left, right):
        ok &= (bits[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1
    return ok


def pair_filter(pairs: DataFrame) -> np.ndarray:
    """Bit array of ``FILTER_BITS`` with two bits set for every pair in ``pairs``.

    Its size is fixed, so it is bounded however many pairs there are; with very
    many it lets more phrases through to be counted and nothing else changes.
    """
    width = FILTER_BITS // FILTER_ROWS

    def bits(frames):
        import pandas as pd
        for f in frames:
            at = np.concatenate([np.concatenate(_pair_bits(
                _word_hashes(g["w1"].str.encode("utf-8"), lang), _word_hashes(g["w2"].str.encode("utf-8"), lang)))
                for lang, g in f.groupby("lang")])
            yield pd.DataFrame({"at": np.unique(at)})

    def packed(key, frame):
        import pandas as pd
        out = np.zeros(width, np.uint8)
        out[frame["at"].to_numpy() - key[0] * width] = 1
        return pd.DataFrame({"part": [key[0]], "bits": [np.packbits(out, bitorder="little").tobytes()]})

    # the bits of one part are distinct rows below `width`, whatever the corpus
    rows = pairs.select("lang", "w1", "w2").mapInPandas(bits, "at long").distinct() \
        .groupBy(F.expr(f"at div {width}").alias("part")).applyInPandas(packed, "part long, bits binary").collect()
    out = np.zeros(FILTER_BITS // 8, np.uint8)
    for r in rows:
        out[r["part"] * width // 8:(r["part"] + 1) * width // 8] = np.frombuffer(r["bits"], np.uint8)
    return out


def phrase_counts(docs: DataFrame, least: int = 10, text_col: str = "text", lang_col: str = "lang"):
    """``(counts, totals)``: ``lang, w1, w2, w3, a`` of all phrases of one to
    three words that occur ``least`` times, and ``lang, n``, all words of it."""
    spark = docs.sparkSession
    texts = docs.select(F.coalesce(F.col(lang_col).cast("string"), F.lit("und")).alias("lang"),
                        whole_text(text_col).cast("binary").alias("text"))

    def added(rows):
        return rows.groupBy("lang", "w1", "w2", "w3").agg(F.sum("cnt").alias("a"))

    small = stage(added(texts.mapInArrow(_words_and_pairs, COUNTS))
                  .where((F.col("a") >= least) | F.col("w1").isNull()), "phrases")
    totals = small.where("w1 IS NULL").select("lang", F.col("a").alias("n"))
    frequent = small.where((F.col("a") >= least) & F.col("w1").isNotNull())
    bits = spark.sparkContext.broadcast(pair_filter(frequent.where("w2 IS NOT NULL")))
    triples = added(texts.mapInArrow(lambda b: _triples(b, bits.value), COUNTS)).where(F.col("a") >= least)
    return frequent.unionByName(triples), totals


def _walk(stream: DataFrame, words: list[str], one: str, two: str) -> DataFrame:
    """The stream in the order of ``words``, each phrase with ``one`` and ``two``,
    the counts of its first one and two words in that order.

    Every frequent phrase's beginnings are frequent, so they are in the stream,
    before it; the last phrase of one (two) words passed is its beginning.
    """
    # The checkpoint fixes which row is in which partition for both steps below.
    s = cut_lineage(stream.orderBy("lang", *words))
    single, double = F.col(words[1]).isNull(), F.col(words[1]).isNotNull() & F.col(words[2]).isNull()
    key = F.struct("lang", *words, "a")
    heads = s.groupBy(F.spark_partition_id().alias("part")).agg(
        F.max(F.when(single, key))["a"].alias("one"), F.max(F.when(double, key))["a"].alias("two")).collect()
    starts, last = {}, (None, None)
    for r in sorted(heads, key=lambda r: r["part"]):  # a row per partition
        starts[r["part"]] = last
        last = (r["one"] or last[0], r["two"] or last[1])

    def run(frames):
        from pyspark import TaskContext
        carry = starts.get(TaskContext.get().partitionId(), (None, None))
        for f in frames:
            if len(f):
                second, third = f[words[1]].isna(), f[words[2]].isna()
                marks = f["a"].where(second), f["a"].where(third & ~second)
                filled = [m.ffill().fillna(0 if c is None else c).astype("int64") for m, c in zip(marks, carry)]
                carry = tuple(int(m.iloc[-1]) or None for m in filled)
                yield f.assign(**{one: filled[0], two: filled[1]})

    names = ", ".join(f"{c} {t}" for c, t in s.dtypes)
    return s.mapInPandas(run, f"{names}, {one} long, {two} long")


def collocations(docs: DataFrame, least: int = 10, cover: int = 50, per_lang: int = 2000,
                 text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """``lang, rank, phrase, a, l, r, n, score``: each language's best phrases.

    Candidates are phrases of two or three words of one piece with count ``a``
    of at least ``least``; ``l`` and ``r`` are the counts of the two parts at the
    cut with the smallest ``score`` = floor(10^6 a a / (l r)), the leftmost of
    equal ones; ``n`` counts the language's words. Dropped are candidates inside
    a longer one whose count is at least ``cover`` percent of theirs. Products
    are exact decimals of 38 digits (counts up to 10^15). Null languages are
    ``und``, null texts empty, repeated rows count each; other columns of
    ``docs`` don't matter. Ties rank by count, then phrase in byte order. An
    empty table, or one without candidates, gives no rows.
    """
    counts, totals = phrase_counts(docs, least, text_col, lang_col)
    ahead = _walk(counts, ["w1", "w2", "w3"], "p1", "p2")
    # suffix order: the last word first
    turned = ahead.select(
        "lang", F.coalesce("w3", "w2", "w1").alias("e1"),
        F.when(F.col("w3").isNotNull(), F.col("w2")).when(F.col("w2").isNotNull(), F.col("w1")).alias("e2"),
        F.when(F.col("w3").isNotNull(), F.col("w1")).alias("e3"), "a", "p1", "p2")
    both = stage(_walk(turned, ["e1", "e2", "e3"], "s1", "s2").where("e2 IS NOT NULL"), "collocations")

    def score(l, r):
        wide = "cast({} as decimal(18,0))".format
        return F.expr(f"({wide('a')} * {wide('a')} * 1000000) div ({wide(l)} * {wide(r)})")

    long = F.col("e3").isNotNull()
    first = F.when(long, score("p1", "s2")).otherwise(score("p1", "s1"))
    second = F.when(long, score("p2", "s1"))
    cut = second < first  # null for pairs
    scored = both.select(
        "lang", F.col("e1"), F.col("e2"), F.concat_ws(" ", "e3", "e2", "e1").alias("phrase"), long.alias("long"), "a",
        F.when(cut, F.col("p2")).otherwise(F.col("p1")).alias("l"),
        F.when(long & ~cut, F.col("s2")).otherwise(F.col("s1")).alias("r"),
        F.when(cut, second).otherwise(first).alias("score"))
    # phrases a frequent extension to the right (left) covers
    threes = both.where(long)
    covered = threes.where(f"100 * a >= {cover} * p2").select("lang", F.concat_ws(" ", "e3", "e2").alias("phrase")) \
        .unionByName(threes.where(f"100 * a >= {cover} * s2")
                     .select("lang", F.concat_ws(" ", "e2", "e1").alias("phrase"))).distinct()
    kept = scored.where("long").unionByName(
        scored.where("NOT long").join(covered.hint("merge"), ["lang", "phrase"], "left_anti")
        .select(scored.columns)).drop("e1", "e2", "long")
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    best = top_n_per_group(kept, "lang", order, per_lang).join(totals.hint("merge"), "lang")
    return best.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order))) \
        .select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
