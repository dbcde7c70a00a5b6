"""Distances and nearest neighbours: N1-N7.

Two exact strategies, picked by the shape of the data:

* ``cosine_within`` / ``jaccard_within`` (sparse, thresholded): prefix
  filtering (Bayardo, Ma, Srikant, "Scaling up all pairs similarity search",
  WWW 2007). Terms get one global order, rarest first. Each unit indexes only
  the prefix of its terms that the pair bound needs; two units can only be
  within the threshold if they share an indexed term, so the candidate
  self-join runs on those short posting lists. Candidates are then scored
  exactly on their full vectors. Long posting lists are split by AQE's skew
  join; no pair is dropped.

* ``dense_pairs`` / ``nearest`` (dense vectors, or a full distance table):
  vectors are hashed into blocks (``nearest``: of about ``block_rows``; ``dense_pairs``: of
  about ``GROUP_TILES`` times as many, gone through in tiles); each block pair
  (a <= b) is one task that receives the two blocks (each vector is sent to
  ``n_blocks`` tasks) and computes the distances with numpy. Only pairs under
  the threshold (or the per-row best, for ``nearest``) leave the task.
  The full table is quadratic by definition; use it on a sample (T2) at scale.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kindred.functions.rank import global_row_number
from kindred.operators.vectorize import document_frequency
from kindred.session import cut_lineage, store

_EPS = 1e-9


# ---------------------------------------------------------------- sparse, exact

def _prefix_terms(weights: DataFrame, df: DataFrame, theta: float, key: str) -> DataFrame:
    """Indexed (prefix) terms of each unit for cosine >= theta on unit vectors.

    Walking a unit's terms from the commonest end, the suffix is the longest
    run whose squared norm stays below theta^2; everything else is indexed.
    """
    order = Window.partitionBy("unit_id").orderBy(F.desc("df"), F.desc(key)) \
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    x = weights.join(F.broadcast(df.select(key, "df")), key)
    x = x.withColumn("suffix_sq", F.sum(F.col("w") * F.col("w")).over(order))
    bound = max(theta * theta - _EPS, 0.0)
    return x.where(F.col("suffix_sq") >= bound).select("unit_id", key)


def candidate_pairs(indexed: DataFrame, key: str = "idx") -> DataFrame:
    """Distinct ``i < j`` sharing at least one indexed term."""
    a = indexed.select(F.col("unit_id").alias("i"), F.col(key).alias("__k"))
    b = indexed.select(F.col("unit_id").alias("j"), F.col(key).alias("__k"))
    return a.join(b, "__k").where(F.col("i") < F.col("j")).select("i", "j").distinct()


def cosine_within(weights: DataFrame, t: float, df: DataFrame | None = None,
                  key: str = "idx", value: str = "w", strategy: str = "auto",
                  dim: int | None = None, forest: bool = False,
                  block_rows: int = 1024) -> DataFrame:
    """N3 (cosine, thresholded): all ``i < j`` with ``1 - cos < t``.

    ``weights`` holds L2-normalised non-negative vectors (``tfidf``), one row
    per (unit, term). Returns ``i, j, dist``. Strategies, both exact:
    ``prefix`` (candidate join on indexed terms, then exact scoring) and
    ``blocks`` (BLAS per block pair over a bounded ``dim``, the vocabulary
    size). ``auto`` estimates the prefix join's size from the posting lists and
    takes blocks when the candidates would be a large share of all pairs.
    ``forest`` (blocks only) returns a spanning forest of the pairs instead.
    From ``t = 1`` on, pairs need not share a term: ``prefix`` refuses such a
    threshold and ``auto`` takes blocks.
    """
    if t >= 1:
        if strategy == "prefix":
            raise ValueError("prefix finds only pairs that share a term: t must be below 1")
        strategy = "blocks"
    theta = 1.0 - t
    w = weights.select("unit_id", F.col(key).alias("idx"), F.col(value).alias("w"))
    if df is None:
        df = document_frequency(w, "idx")
    vec = w.groupBy("unit_id").agg(
        F.map_from_entries(F.collect_list(F.struct("idx", "w"))).alias("vec"))
    n_units = n_cells = None
    if strategy == "auto" and dim is not None and dim <= MAX_BLOCK_DIM:
        vec = store(vec)  # cells are shuffled for it once, and for no estimate
        n_units, n_cells = vec.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.size("vec")), F.lit(0))).first()
        strategy = _cheaper(n_units, dim, lambda: _posting_pairs(vec, df, theta, dim))
    elif strategy == "auto":
        strategy, n_units = _choose(_prefix_terms(w, df, theta, "idx"), w, dim)
    if strategy == "blocks":
        if dim is None:
            dim = w.agg(F.max("idx")).first()[0] + 1
        return dense_pairs(vec, "cosine", t, "unit_id", "vec", block_rows=block_rows,
                           kind="sparse", dim=dim, forest=forest, n_rows=n_units,
                           n_cells=w.count() if n_cells is None and n_units is not None else n_cells)
    cand = candidate_pairs(_prefix_terms(w, df, theta, "idx"), "idx")
    vi = vec.select(F.col("unit_id").alias("i"), F.col("vec").alias("vi"))
    vj = vec.select(F.col("unit_id").alias("j"), F.col("vec").alias("vj"))
    scored = cand.join(vi, "i").join(vj, "j").select(
        "i", "j",
        F.aggregate(
            F.map_values(F.map_zip_with("vi", "vj",
                                        lambda k, a, b: F.coalesce(a * b, F.lit(0.0)))),
            F.lit(0.0), lambda acc, x: acc + x).alias("sim"))
    return scored.select("i", "j", (F.lit(1.0) - F.col("sim")).alias("dist")) \
        .where(F.col("dist") < t)


# Blocks cost about n^2 * dim multiply-adds in BLAS; the prefix join about
# (posting pairs) row operations in the JVM. A row operation costs roughly as
# much as this many BLAS multiply-adds:
ROW_OP_FLOPS = 20000.0
MAX_BLOCK_DIM = 8192
# Block work this small (about 20 s of one core) is taken without estimating
BLOCKS_CHEAP_FLOPS = 2e11


def _cheaper(n: int, dim: int, posting_pairs) -> str:
    """The cheaper strategy for ``n`` units; ``posting_pairs()`` is asked only if blocks are dear."""
    flops = n * n / 2.0 * dim
    return "blocks" if flops <= BLOCKS_CHEAP_FLOPS or flops < posting_pairs() * ROW_OP_FLOPS else "prefix"


def _posting_pairs(vec: DataFrame, df: DataFrame, theta: float, dim: int) -> float:
    """Pairs in the posting lists of the terms that ``_prefix_terms`` keeps, found inside each
    unit's row: only counts of at most ``dim`` terms a task are shuffled."""
    common, bound = np.zeros(dim, dtype=np.int64), max(theta * theta - _EPS, 0.0)
    for idx, n in df.select("idx", "df").collect():  # at most ``dim`` rows
        common[idx] = n

    def sizes(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            n = frame["k"].map(len).to_numpy().astype(np.int64)
            if not n.sum():
                continue
            k, w = np.concatenate(frame["k"].to_numpy()).astype(np.int64), np.concatenate(frame["v"].to_numpy())
            row = np.repeat(np.arange(len(n)), n)
            order = np.lexsort((-k, -common[k], row))
            so_far = np.cumsum(w[order] ** 2)
            before = np.append(0.0, so_far)[np.cumsum(n) - n]
            term, c = np.unique(k[order][so_far - before[row] >= bound], return_counts=True)
            yield pd.DataFrame({"idx": term, "c": c})

    c = vec.select(F.map_keys("vec").alias("k"), F.map_values("vec").alias("v")) \
        .mapInPandas(sizes, "idx long, c long").groupBy("idx").agg(F.sum("c").alias("c"))
    return float(c.agg(F.sum(F.col("c") * (F.col("c") - 1) / 2)).first()[0] or 0)


def _choose(indexed: DataFrame, w: DataFrame, dim: int | None):
    """``(strategy, n_units)``: every unit indexes at least its rarest term, so
    the units of ``indexed`` are all units."""
    n = indexed.select("unit_id").distinct().count()
    if dim is not None and dim <= MAX_BLOCK_DIM and n * n / 2.0 * dim <= BLOCKS_CHEAP_FLOPS:
        return "blocks", n
    stats = indexed.groupBy("idx").agg(F.count(F.lit(1)).alias("c")).agg(
        F.sum(F.col("c") * (F.col("c") - 1) / 2).alias("pairs"),
        F.max("idx").alias("maxidx")).first()
    d = dim if dim is not None else (stats["maxidx"] or 0) + 1
    if d > MAX_BLOCK_DIM:
        return "prefix", n
    blocks_cost = n * n / 2.0 * d
    prefix_cost = float(stats["pairs"] or 0) * ROW_OP_FLOPS
    return ("blocks" if blocks_cost < prefix_cost else "prefix"), n


def jaccard_within(sets: DataFrame, t: float, key: str = "idx",
                   df: DataFrame | None = None, strategy: str = "auto",
                   dim: int | None = None, block_rows: int = 1024) -> DataFrame:
    """N3 (set Jaccard, thresholded): all ``i < j`` with ``1 - |x&y|/|x|y| < t``.

    ``sets`` holds one row per (unit, term). ``prefix``: for Jaccard >= theta a
    unit indexes its first ``|x| - ceil(theta*|x|) + 1`` terms in the global
    rare-first order, candidates share an indexed term and are scored with
    ``array_intersect``. ``blocks``: 0/1 block matrices over a bounded ``dim``,
    intersections by one matrix product per block pair (exact integers).
    ``auto`` picks by the size of the prefix join, as for cosine.
    """
    theta = 1.0 - t
    s = sets.select("unit_id", F.col(key).alias("idx")).distinct()
    if df is None:
        df = s.groupBy("idx").agg(F.count(F.lit(1)).alias("df"))
    per_unit = Window.partitionBy("unit_id")
    ordered = Window.partitionBy("unit_id").orderBy(F.asc("df"), F.asc("idx"))
    x = s.join(F.broadcast(df.select("idx", "df")), "idx") \
        .withColumn("n", F.count(F.lit(1)).over(per_unit)) \
        .withColumn("r", F.row_number().over(ordered))
    plen = F.col("n") - F.ceil(F.col("n") * F.lit(theta - _EPS)) + 1
    indexed = x.where(F.col("r") <= plen).select("unit_id", "idx")
    n_units = None
    if strategy == "auto":
        strategy, n_units = _choose(indexed, s, dim)
    if strategy == "blocks":
        if dim is None:
            dim = s.agg(F.max("idx")).first()[0] + 1
        vec = s.groupBy("unit_id").agg(
            F.map_from_entries(F.collect_list(F.struct("idx", F.lit(1.0)))).alias("vec"))
        return dense_pairs(vec, "jaccard_set", t, "unit_id", "vec", block_rows=block_rows,
                           kind="sparse", dim=dim, n_rows=n_units,
                           n_cells=None if n_units is None else sets.count())
    cand = candidate_pairs(indexed, "idx")
    arr = s.groupBy("unit_id").agg(F.collect_list("idx").alias("a"))
    ai = arr.select(F.col("unit_id").alias("i"), F.col("a").alias("ai"))
    aj = arr.select(F.col("unit_id").alias("j"), F.col("a").alias("aj"))
    inter = F.size(F.array_intersect("ai", "aj"))
    union = F.size("ai") + F.size("aj") - inter
    out = cand.join(ai, "i").join(aj, "j").select(
        "i", "j", (F.lit(1.0) - inter / union).alias("dist"))
    return out.where(F.col("dist") < t)


def jaccard_cells_within(cells: DataFrame, t: float, key: str = "idx", value: str = "cnt",
                         dim: int | None = None, block_rows: int = 1024) -> DataFrame:
    """N3 ``jaccard`` on real vectors, thresholded: ``i < j, dist`` with ``dist < t``.

    The distance is SciPy's: of the dimensions where either vector is not 0, the
    share where they differ. It is 1 - E / U for E equal non-zero cells (index and
    value) and U dimensions in either, and U is at least either vector's size. So a
    close pair shares more than (1 - t) n of its cells, and cells are the elements
    of a prefix-filtered overlap join: rare cells first, each unit indexes the few it
    cannot do without. ``cells`` has a row per unit and dimension; zeros, and units
    with zeros only, are in no pair. ``t`` is at most 1.

    Below ``t = 1`` and with a bounded ``dim`` (keys are from 0 to ``dim`` - 1) the pairs are
    found in blocks instead: E is at most the shared dimensions, so the set Jaccard distance,
    a matrix product, is never above this one, and only pairs that are close as sets are
    computed cell by cell. No candidate leaves its task.
    """
    if t > 1:
        raise ValueError("pairs without an equal cell have distance 1: t is at most 1")
    x = cells.where(F.col(value) != 0).select("unit_id", F.col(key).alias("k"), F.col(value).cast("double").alias("v"))
    if dim is not None and dim <= MAX_BLOCK_DIM and t < 1:
        vec = x.where("unit_id IS NOT NULL AND k IS NOT NULL").groupBy("unit_id").agg(
            F.map_from_entries(F.collect_list(F.struct("k", "v"))).alias("vec"))
        return dense_pairs(store(vec), "jaccard", t, "unit_id", "vec", block_rows=block_rows, kind="sparse", dim=dim)
    ranked = global_row_number(x.groupBy("k", "v").agg(F.count(F.lit(1)).alias("df")),
                               F.asc("df"), F.asc("k"), F.asc("v"), name="e").select("k", "v", "e")
    rows = cut_lineage(x.join(ranked, ["k", "v"]).groupBy("unit_id").agg(
        F.sort_array(F.collect_list("e")).alias("e"), F.collect_list("k").alias("k")).withColumn("n", F.size("e")))
    need = F.greatest(F.ceil((1 - t) * F.col("n") - 1e-9), F.lit(1))
    indexed = rows.select("unit_id", "n", F.explode(F.slice("e", F.lit(1), (F.col("n") - need + 1).cast("int"))).alias("e"))
    a, b = (indexed.select(F.col("unit_id").alias(u), F.col("n").alias(f"n{u}"), "e") for u in "ij")
    near = a.join(b, "e").where((F.col("i") < F.col("j")) & (
        F.least("ni", "nj") >= (1 - t) * F.greatest("ni", "nj") - 1e-9)).select("i", "j").distinct()
    both = near
    for u in "ij":
        both = both.join(rows.select(F.col("unit_id").alias(u), *[F.col(c).alias(f"{c}{u}") for c in ("e", "k", "n")]), u)
    equal = F.size(F.array_intersect("ei", "ej"))
    either = F.col("ni") + F.col("nj") - F.size(F.array_intersect("ki", "kj"))
    return both.select("i", "j", ((either - equal) / either).alias("dist")).where(F.col("dist") < t)


MERSENNE = 2 ** 31 - 1  # prime modulus of the minimum hashes


def hash_parameters(n: int) -> list[tuple[int, int]]:
    """Factor and offset of ``n`` linear hashes: powers of two primitive roots modulo ``MERSENNE``."""
    return [(pow(48271, h + 1, MERSENNE), pow(69621, h + 1, MERSENNE)) for h in range(n)]


def banding(theta: float, recall: float, max_hashes: int) -> tuple[int, int]:
    """``(rows, bands)``: most rows a band for which two sets of similarity ``theta`` agree
    in some band with probability ``recall``, within ``max_hashes`` hashes."""
    best = None
    for rows in range(1, max_hashes + 1):
        agree = theta ** rows
        bands = 1 if agree >= recall else math.ceil(math.log(1 - recall) / math.log1p(-agree))
        if rows * bands > max_hashes:
            break
        best = rows, bands
    if best is None:
        raise ValueError("more hashes are needed for this threshold and recall")
    return best


def jaccard_within_approx(sets: DataFrame, t: float, key: str = "idx", recall: float = 0.97,
                          max_hashes: int = 96, chunk_rows: int = 8192) -> DataFrame:
    """N3(c): pairs ``i < j, dist`` with set Jaccard distance below ``t`` that share a bucket.

    Buckets are bands of minimum hashes (Broder 1997): a pair at distance ``t`` is
    missed with probability ``1 - recall`` at most under ideal hashes, a closer one
    less often, and no pair is reported that is not within ``t`` exactly. A unit's set goes
    with it into its buckets and pairs are scored there as bit sets, so only close pairs are shuffled,
    no candidates; a set whose bucket holds no other one is not sent. A bucket of
    more than ``chunk_rows`` units is split: its members are dealt to chunks and
    each two chunks are a task's group, so no pair of a large bucket is lost and no
    group holds more than about two chunks. ``key`` is an integer column; units
    without terms (or with null ones only) are in no pair. ``0 < t < 1``.
    """
    if not 0 < t < 1:
        raise ValueError("t must lie between 0 and 1: buckets find pairs that share a term")
    rows, bands = banding(1 - t, recall, max_hashes)
    term = F.pmod(F.col(key).cast("long"), F.lit(MERSENNE))
    low = [F.min((F.lit(a) * term + F.lit(b)) % MERSENNE).alias(f"h{n}")
           for n, (a, b) in enumerate(hash_parameters(rows * bands))]
    units = store(sets.where(F.col(key).isNotNull() & F.col("unit_id").isNotNull()).groupBy("unit_id").agg(
        F.collect_set(key).alias("a"), *low))
    member = units.select("unit_id", F.posexplode(F.array(*[
        F.array(*[f"h{n}" for n in range(b * rows, b * rows + rows)]) for b in range(bands)])).alias("band", "sig"))
    shared = store(member.groupBy("band", "sig").agg(F.count(F.lit(1)).alias("n")).where("n > 1"))
    large = shared.where(F.col("n") > chunk_rows).select("band", "sig", F.ceil(F.col("n") / chunk_rows).cast("int").alias("chunks"))
    chunks = F.coalesce("chunks", F.lit(1))
    own = F.pmod(F.xxhash64("unit_id"), chunks).cast("int")
    name = F.concat_ws(",", F.col("band").cast("string"), F.col("sig").cast("array<string>"))
    into = member.join(shared.select("band", "sig"), ["band", "sig"], "left_semi").join(large, ["band", "sig"], "left") \
        .select("unit_id", F.struct(name.alias("name"), chunks.alias("chunks"), own.alias("own")).alias("b")) \
        .groupBy("unit_id").agg(F.collect_list("b").alias("b"))
    lo, hi = F.least("b.own", "other"), F.greatest("b.own", "other")
    dealt = into.join(units.select("unit_id", "a"), "unit_id").select("unit_id", "a", F.explode("b").alias("b")) \
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("b.chunks") - 1))) \
        .select(F.concat_ws(",", "b.name", lo.cast("string"), hi.cast("string")).alias("bucket"), "unit_id",
                F.when(lo < hi, F.col("b.own")).otherwise(-1).alias("own"), "a")  # -1: all pairs of the bucket
    sent = shared.agg(F.sum(F.col("n") * F.ceil(F.col("n") / chunk_rows))).first()[0] or 0
    cells = units.agg(F.avg(F.size("a"))).first()[0] or 0
    tasks = max(sets.sparkSession.sparkContext.defaultParallelism, math.ceil(sent / BUCKET_ROWS),
                math.ceil(sent * cells / GROUP_CELLS))
    kind = sets.schema["unit_id"].dataType.simpleString()
    return dealt.repartition(tasks, "bucket").sortWithinPartitions("bucket") \
        .mapInPandas(lambda frames: _bucket_pairs(frames, t), f"i {kind}, j {kind}, dist double").dropDuplicates(["i", "j"])


BUCKET_ROWS = 1 << 16  # rows of buckets that a task scores at a time; one bucket may be more
_SCORED = 1 << 15  # pairs scored at a time


def _bucket_pairs(frames: Iterator[pd.DataFrame], t: float) -> Iterator[pd.DataFrame]:
    """``i, j, dist`` of the pairs within ``t`` in each bucket; rows come in order of their bucket."""
    held, n, most = [], 0, BUCKET_ROWS
    for frame in frames:
        held.append(frame)
        n += len(frame)
        if n >= most:
            part = pd.concat(held, ignore_index=True)
            last = int((part["bucket"] != part["bucket"].iloc[-1]).sum())  # where the bucket that may go on starts
            yield from _score_buckets(part[:last], t)
            held, n = [part[last:]], len(part) - last
            most = n + BUCKET_ROWS
    if n:
        yield from _score_buckets(pd.concat(held, ignore_index=True), t)


def _score_buckets(part: pd.DataFrame, t: float) -> Iterator[pd.DataFrame]:
    """Pairs of whole buckets, by offsets in order of size: a set is at least 1 - t of the other's
    size, or the two, and all pairs with larger ones, are not within ``t``.

    Sets are rows of bits. More than ``MAX_BLOCK_DIM`` terms share bits: then common bits and the
    smaller set's lost ones bound the intersection, and what the bound admits is computed.
    """
    if not len(part):
        return
    bucket, size = part["bucket"].to_numpy(), part["a"].map(len).to_numpy().astype(np.int64)
    group = np.cumsum(np.append(False, bucket[1:] != bucket[:-1]))
    order = np.lexsort((size, group))
    group, size, ids, own = group[order], size[order], part["unit_id"].to_numpy()[order], part["own"].to_numpy()[order]
    sets = part["a"].to_numpy()[order]
    terms, code = np.unique(np.concatenate(sets), return_inverse=True)
    folded, code = len(terms) > MAX_BLOCK_DIM, code % MAX_BLOCK_DIM
    bits = np.zeros((len(ids), min(len(terms), MAX_BLOCK_DIM) // 64 + 1), dtype=np.uint64)
    np.bitwise_or.at(bits, (np.repeat(np.arange(len(ids)), size), code >> 6), np.uint64(1) << (code & 63).astype(np.uint64))
    lost = size - np.bitwise_count(bits).sum(1, dtype=np.int64)

    def close(r: np.ndarray, s: np.ndarray) -> pd.DataFrame:
        shared = np.bitwise_count(bits[r] & bits[s]).sum(1, dtype=np.int64) + np.minimum(lost[r], lost[s])
        dist = 1.0 - shared / (size[r] + size[s] - shared)
        if folded:
            r, s = r[dist < t], s[dist < t]
            shared = np.array([len(np.intersect1d(sets[p], sets[q], assume_unique=True)) for p, q in zip(r, s)], dtype=np.int64)
            dist = 1.0 - shared / (size[r] + size[s] - shared)
        near = dist < t
        a, b = ids[r[near]], ids[s[near]]
        return pd.DataFrame({"i": np.where(a < b, a, b), "j": np.where(a < b, b, a), "dist": dist[near]})

    r, d, waiting, n = np.arange(len(ids)), 0, [], 0
    while len(r):
        d += 1
        r = r[r + d < len(ids)]
        r = r[(group[r] == group[r + d]) & (size[r] >= (1 - t) * size[r + d] - 1e-9)]
        pair = r[(own[r] < 0) | (own[r] != own[r + d])]
        waiting.append((pair, pair + d))
        n += len(pair)
        if n >= _SCORED or not len(r):
            left, right = (np.concatenate(x) for x in zip(*waiting))
            for at in range(0, n, _SCORED):
                yield close(left[at:at + _SCORED], right[at:at + _SCORED])
            waiting, n = [], 0


def binary_cells(sets: DataFrame, pairs: DataFrame, n_terms: int, key: str = "idx") -> DataFrame:
    """2x2 cell counts of two 0-1 vectors for each given pair.

    ``n11`` from the shared terms, ``n10``/``n01`` from the set sizes, ``n00`` is
    the rest of the ``n_terms`` dimensions.
    """
    arr = sets.select("unit_id", key).distinct().groupBy("unit_id").agg(
        F.collect_list(key).alias("a"))
    ai = arr.select(F.col("unit_id").alias("i"), F.col("a").alias("ai"))
    aj = arr.select(F.col("unit_id").alias("j"), F.col("a").alias("aj"))
    x = pairs.select("i", "j").join(ai, "i").join(aj, "j")
    n11 = F.size(F.array_intersect("ai", "aj"))
    return x.select(
        "i", "j", n11.cast("long").alias("n11"),
        (F.size("ai") - n11).cast("long").alias("n10"),
        (F.size("aj") - n11).cast("long").alias("n01"),
        (F.lit(n_terms) - F.size("ai") - F.size("aj") + n11).cast("long").alias("n00"))


# ---------------------------------------------------------------- dense, blocked

def _dist_matrix(X: np.ndarray, Y: np.ndarray, metric: str) -> np.ndarray:
    if metric == "cosine":
        nx = np.linalg.norm(X, axis=1)[:, None]
        ny = np.linalg.norm(Y, axis=1)[None, :]
        with np.errstate(invalid="ignore", divide="ignore"):
            return 1.0 - (X @ Y.T) / (nx * ny)
    if metric == "euclidean":
        sq = (X * X).sum(1)[:, None] + (Y * Y).sum(1)[None, :] - 2.0 * (X @ Y.T)
        return np.sqrt(np.maximum(sq, 0.0))
    if metric == "sqeuclidean":
        sq = (X * X).sum(1)[:, None] + (Y * Y).sum(1)[None, :] - 2.0 * (X @ Y.T)
        return np.maximum(sq, 0.0)
    if metric == "jaccard_set":
        A, B = (X != 0).astype(np.float32), (Y != 0).astype(np.float32)
        inter = (A @ B.T).astype(np.float64)  # integer counts below 2^24, exact in float32
        union = A.sum(1, dtype=np.float64)[:, None] + B.sum(1, dtype=np.float64)[None, :] - inter
        with np.errstate(invalid="ignore", divide="ignore"):
            return np.where(union > 0, 1.0 - inter / union, 0.0)
    if metric in ("jaccard", "jaccard_binary"):
        if metric == "jaccard_binary":
            X, Y = X != 0, Y != 0
        out = np.empty((len(X), len(Y)))
        step = max(1, 4_000_000 // max(1, X.shape[1] * max(1, len(Y))))
        for s in range(0, len(X), step):
            a = X[s:s + step, None, :]
            b = Y[None, :, :]
            nz = (a != 0) | (b != 0)
            ne = (a != b) & nz
            den = nz.sum(2)
            with np.errstate(invalid="ignore", divide="ignore"):
                out[s:s + step] = np.where(den > 0, ne.sum(2) / np.maximum(den, 1), 0.0)
        return out
    raise ValueError(f"unknown metric {metric!r}")


def _exact_rows(X: np.ndarray, Y: np.ndarray, metric: str) -> np.ndarray:
    """Row-wise distance of X[k] to Y[k], computed directly (no expansion)."""
    if metric == "cosine":
        with np.errstate(invalid="ignore", divide="ignore"):
            return 1.0 - (X * Y).sum(1) / (np.linalg.norm(X, axis=1) * np.linalg.norm(Y, axis=1))
    if metric == "euclidean":
        return np.sqrt(((X - Y) ** 2).sum(1))
    if metric == "sqeuclidean":
        return ((X - Y) ** 2).sum(1)
    if metric in ("jaccard", "jaccard_binary"):
        if metric == "jaccard_binary":
            X, Y = X != 0, Y != 0
        nz = (X != 0) | (Y != 0)
        ne = (X != Y) & nz
        den = nz.sum(1)
        return np.where(den > 0, ne.sum(1) / np.maximum(den, 1), 0.0)
    raise ValueError(metric)


def _pair_values(D: np.ndarray, X: np.ndarray, Y: np.ndarray, r: np.ndarray, c: np.ndarray,
                 metric: str, chunk_elems: int = 1 << 22, exact: bool = False) -> np.ndarray:
    """Distances of the kept cells. Cosine and Jaccard matrix values are
    already exact to rounding; the Euclidean forms come from an expansion that
    cancels for near points, so those cells are recomputed directly, in
    chunks that bound the memory of the gathered rows; all are if ``exact``."""
    if metric not in ("euclidean", "sqeuclidean") and not exact:
        return D[r, c]
    out = np.empty(len(r))
    step = max(1, chunk_elems // max(1, X.shape[1]))
    for s in range(0, len(r), step):
        out[s:s + step] = _exact_rows(X[r[s:s + step]], Y[c[s:s + step]], metric)
    return out


def n_blocks_for(n_rows: int, block_rows: int) -> int:
    return max(1, math.ceil(n_rows / block_rows))


def _block_input(vectors: DataFrame, id_col: str, vec_col: str, n_blocks: int,
                 kind: str = "dense") -> DataFrame:
    own = F.pmod(F.xxhash64(F.col(id_col)), F.lit(n_blocks)).cast("int")
    if kind == "dense":
        cols = [F.col(vec_col).cast("array<double>").alias("v")]
    else:  # sparse map<idx, w>: ship keys and values as two aligned arrays
        cols = [F.map_keys(F.col(vec_col)).cast("array<int>").alias("k"),
                F.map_values(F.col(vec_col)).cast("array<double>").alias("v")]
    x = vectors.select(F.col(id_col).cast("long").alias("id"), *cols, own.alias("own"))
    x = x.withColumn("partner", F.explode(F.sequence(F.lit(0), F.lit(n_blocks - 1))))
    return x.select(F.least("own", "partner").alias("ba"),
                    F.greatest("own", "partner").alias("bb"), "own", "id",
                    *(["k"] if kind != "dense" else []), "v")


def _matrix(part: pd.DataFrame, dim: int | None) -> np.ndarray:
    if "k" not in part.columns:
        return np.array(part["v"].tolist(), dtype=np.float64).reshape(len(part), -1)
    X = np.zeros((len(part), dim), dtype=np.float64)
    lens = part["k"].map(len).to_numpy()
    if lens.sum():
        rows = np.repeat(np.arange(len(part)), lens)
        X[rows, np.concatenate(part["k"].to_numpy())] = np.concatenate(part["v"].to_numpy())
    return X


def _split(pdf: pd.DataFrame, dim: int | None = None):
    ba, bb = int(pdf["ba"].iloc[0]), int(pdf["bb"].iloc[0])
    left = pdf[pdf["own"] == ba]
    right = left if ba == bb else pdf[pdf["own"] == bb]
    X = _matrix(left, dim)
    Y = X if ba == bb else _matrix(right, dim)
    return ba == bb, left["id"].to_numpy(), X, right["id"].to_numpy(), Y


MAX_HELD_CELLS = 40_000_000  # cells of a group whose densified tiles a task keeps (20 bytes each)


class _Side:
    """The vectors of one group as tiles of ``rows`` rows; sparse ones are densified tile by tile.

    ``parts`` are the batches of the group's rows. Those of sparse ones are packed as they
    come: flat arrays of 12 bytes a cell, no objects for rows.
    """

    def __init__(self, parts: list, rows: int, dim: int | None, metric: str):
        self.ids = np.concatenate([p["id"] for p in parts])
        self.sparse, self.dim = "k" in parts[0], dim
        if not self.sparse:
            self.X = np.concatenate([p["X"] for p in parts])
        else:
            # alike rows in one tile: the smallest term number is the commonest term, about the language
            size, first = np.concatenate([p["n"] for p in parts]), np.concatenate([p["first"] for p in parts])
            self.k, self.v = np.concatenate([p["k"] for p in parts]), np.concatenate([p["v"] for p in parts])
            bucket = np.log2(np.maximum(size, 1)).astype(int) if metric == "jaccard_set" else np.zeros(len(size), dtype=int)
            order = np.lexsort((size, first, bucket))
            self.start, self.size, self.ids = (np.cumsum(size) - size)[order], size[order], self.ids[order]
        self.tiles = [np.arange(s, min(s + rows, len(self.ids))) for s in range(0, len(self.ids), rows)]
        self.metric, self.held = metric, {}
        # tiles held at a time
        self.hold = max(1, MAX_HELD_CELLS // max(1, rows * (dim or self.X.shape[1])))

    def blocks(self, start: int = 0):
        """Numbers of the tiles from ``start``, as many at a time as are held."""
        for at in range(start, len(self.tiles), self.hold):
            self.held.clear()
            yield range(at, min(at + self.hold, len(self.tiles)))
        self.held.clear()

    def rows(self, n: int, held: bool = False) -> _Rows:
        """The tile with its bounds; ``held`` until the next block of tiles."""
        got = self.held.get(n) or _Rows(self.matrix(n), self.metric)
        if held:
            self.held[n] = got
        return got

    def matrix(self, n: int) -> np.ndarray:
        pos = self.tiles[n]
        if not self.sparse:
            return self.X[pos[0]:pos[-1] + 1]
        out, size = np.zeros((len(pos), self.dim)), self.size[pos]
        ends = np.cumsum(size)
        at = np.arange(ends[-1]) + np.repeat(self.start[pos] - ends + size, size)
        out[np.repeat(np.arange(len(pos)), size), self.k[at]] = self.v[at]
        return out


def _packed(part: pd.DataFrame) -> dict:
    """A batch of a group's rows in flat arrays (``_Side``)."""
    ids = part["id"].to_numpy(copy=True)
    if "k" not in part.columns:
        return {"id": ids, "X": _matrix(part, None)}
    n = part["k"].map(len).to_numpy().astype(np.int64)
    k = np.concatenate([np.empty(0, np.int32), *part["k"]]).astype(np.int32)
    first = np.full(len(n), -1, dtype=np.int64)
    if len(k):
        first[n > 0] = np.minimum.reduceat(k, (np.cumsum(n) - n)[n > 0])
    return {"id": ids, "n": n, "first": first, "k": k, "v": np.concatenate([np.empty(0), *part["v"]])}


class _Rows:
    """What the bounds of a tile's rows need: squares, norms and the columns in use."""

    def __init__(self, X: np.ndarray, metric: str):
        self.X, self.weight = X, (X != 0).astype(np.float64) if metric == "jaccard_set" else X * X
        self.total = self.weight.sum(1)
        self.used = (X != 0).any(0).astype(np.float64)
        self.unit = None

    def unit32(self) -> np.ndarray:
        """Rows of length 1 in float32 (for screens)."""
        if self.unit is None:
            with np.errstate(invalid="ignore", divide="ignore"):
                self.unit = (self.X / np.sqrt(self.total)[:, None]).astype(np.float32)
            self.most = int((self.X != 0).sum(1).max(initial=0))
        return self.unit


def _may_be_close(x: _Rows, y: _Rows, metric: str, t: float | None):
    """Row numbers of both tiles outside of which no pair is within ``t``.

    Only columns used in the other tile add to a product. Cosine: the product is at
    most the product of both rows' norms over those columns (Cauchy-Schwarz). Sets: the
    intersection is at most the elements there, and is at least 1 - t of the larger set.
    """
    if t is None or t >= 1 or metric not in ("cosine", "jaccard_set"):
        return np.arange(len(x.X)), np.arange(len(y.X))
    theta, shared, back = 1.0 - t, x.weight @ y.used, y.weight @ x.used
    if metric == "cosine":
        with np.errstate(invalid="ignore", divide="ignore"):
            sx, sy = (np.nan_to_num(np.sqrt(v)) for v in (shared / x.total, back / y.total))
        r = np.nonzero(sx * sy.max() >= theta - 1e-6)[0]
        return r, np.nonzero(sy * sx[r].max(initial=0.0) >= theta - 1e-6)[0]
    r = np.nonzero((shared >= theta * np.maximum(x.total, y.total.min()) - 1e-6)
                   & (x.total * theta <= y.total.max() + 1e-6))[0]
    if not len(r):
        return r, r
    c = np.nonzero((back >= theta * np.maximum(y.total, x.total[r].min()) - 1e-6)
                   & (y.total * theta <= x.total[r].max() + 1e-6))[0]
    return r, c


def _merge(comp: np.ndarray, p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Labels of positions after the components of ``p`` and ``q`` are joined pairwise."""
    a, b = comp[p], comp[q]
    edges = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)], axis=1)[a != b], axis=0)
    if not len(edges):
        return comp
    parent: dict = {}

    def find(x):
        root = x
        while parent.get(root, root) != root:
            root = parent[root]
        while parent.get(x, x) != root:
            parent[x], x = root, parent[x]
        return root

    for u, v in edges.tolist():
        ru, rv = find(u), find(v)
        if ru != rv:
            parent[max(ru, rv)] = min(ru, rv)
    to = np.arange(len(comp))
    for u in list(parent):
        to[u] = find(u)
    return to[comp]


def _forest_cells(x: _Rows, y: _Rows, r: np.ndarray, c: np.ndarray, la: np.ndarray, lb: np.ndarray,
                  metric: str, t: float, sparse: bool):
    """Cells of rows ``r`` and columns ``c`` within ``t`` whose labels differ, in two batches.

    Rows with the tile's commonest label meet only columns without it. Cosines of
    sparse rows are screened in float32 (a product has at most as many terms as a row
    has cells); what its rounding leaves open is computed in float64.
    """
    names, n = np.unique(lb, return_counts=True)
    most = names[np.argmax(n)]
    for p, q in ((la != most, np.ones(len(c), dtype=bool)), (la == most, lb != most)):
        rows, cols = r[p], c[q]
        if not len(rows) or not len(cols):
            continue
        other = la[p][:, None] != lb[q][None, :]
        if sparse and metric == "cosine":
            S = x.unit32()[rows] @ y.unit32()[cols].T
            margin = (min(x.most, y.most) + 16) * 1.2e-7
            close = other & (S > 1.0 - t + margin)
            i, j = np.nonzero(other & ~close & (S > 1.0 - t - margin))
            near = np.concatenate([np.empty(0, dtype=bool)] + [
                _exact_rows(x.X[rows[i[k:k + 2048]]], y.X[cols[j[k:k + 2048]]], metric) < t for k in range(0, len(i), 2048)])
            close[i[near], j[near]] = True
            i, j = np.nonzero(close)
        else:
            X, Y = x.X[rows], y.X[cols]
            D = _dist_matrix(X, Y, metric)
            i, j = np.nonzero(other & (D <= t + 1e-7))
            near = _pair_values(D, X, Y, i, j, metric) < t
            i, j = i[near], j[near]
        yield rows[i], cols[j]


FOLD = 768  # columns of a folded tile
FOLD_CHUNK = 4096  # pairs computed at a time
FOLD_HELD = 128  # folded tiles of a group that a task keeps (3 MB each)


class _Folded:
    """A sparse side's rows of length 1, and its tiles folded to ``FOLD`` columns for screens.

    A folded column is the norm of a row over a group of columns, so the product of two folded
    rows is at least that of the rows (Cauchy-Schwarz in each group). Two thirds of
    the groups are single columns, the commonest, so little is lost: the rare columns of a group seldom meet.
    """

    def __init__(self, side: _Side, group: np.ndarray):
        at = np.arange(len(side.k)) + np.repeat(side.start - np.cumsum(side.size) + side.size, side.size)
        self.k, self.size, self.start = side.k[at], side.size, np.cumsum(side.size) - side.size
        row = np.repeat(np.arange(len(self.size)), self.size)
        norm = np.sqrt(np.bincount(row, side.v[at] ** 2, minlength=len(self.size)))
        with np.errstate(invalid="ignore", divide="ignore"):
            self.v = np.nan_to_num(side.v[at] / norm[row])
        self.group, self.width, self.dim, self.held, self.tiles = group, int(group.max()) + 1, len(group), {}, side.tiles
        self.used = []
        for n in range(len(side.tiles)):
            used = np.zeros(self.dim)
            used[self.cells(n)[0]] = 1.0
            self.used.append(used)
        side.k = side.v = None  # in order of the rows here

    def cells(self, n: int):
        """Columns, values and row numbers in the tile of its cells."""
        pos = self.tiles[n]
        cut = slice(self.start[pos[0]], self.start[pos[-1]] + self.size[pos[-1]])
        return self.k[cut], self.v[cut], np.repeat(np.arange(len(pos)), self.size[pos])

    def folded(self, n: int) -> np.ndarray:
        if n not in self.held:
            if len(self.held) >= FOLD_HELD:
                self.held.clear()
            (k, v, row), rows = self.cells(n), len(self.tiles[n])
            squares = np.bincount(row * self.width + self.group[k], v * v, minlength=rows * self.width)
            self.held[n] = np.sqrt(squares).astype(np.float32).reshape(rows, self.width)
        return self.held[n]

    def dense(self, n: int) -> np.ndarray:
        k, v, row = self.cells(n)
        out = np.zeros((len(self.tiles[n]), self.dim))
        out[row, k] = v
        return out

    def reach(self, n: int, used: np.ndarray) -> np.ndarray:
        """Norms of the tile's rows over the columns in use elsewhere."""
        k, v, row = self.cells(n)
        return np.sqrt(np.bincount(row, v * v * used[k], minlength=len(self.tiles[n])))

    def products(self, X: np.ndarray, i: np.ndarray, n: int, j: np.ndarray) -> np.ndarray:
        """Product of row ``i`` of ``X`` and row ``j`` of the tile, for each two."""
        rows = self.tiles[n][j]
        size = self.size[rows]
        pair = np.repeat(np.arange(len(rows)), size)
        at = np.arange(len(pair)) + np.repeat(self.start[rows] - np.cumsum(size) + size, size)
        return np.bincount(pair, X[i[pair], self.k[at]] * self.v[at], minlength=len(rows))


def _fold_groups(k: np.ndarray, dim: int) -> np.ndarray:
    """Group of each column: the commonest are alone, the others are dealt in turn."""
    group, order = np.arange(dim), np.argsort(-np.bincount(k, minlength=dim), kind="stable")
    if dim > FOLD:
        alone = FOLD * 2 // 3
        group[order] = np.append(np.arange(alone), alone + np.arange(dim - alone) % (FOLD - alone))
    return group


def _cosine_labels(a: _Side, b: _Side, same: bool, t: float) -> np.ndarray:
    """Labels of the rows of ``a`` (and behind them ``b``'s) connected by pairs of both within ``t``.

    Only rows whose labels differ are compared: those with a tile's commonest label meet
    only columns without it. Folded rows screen in float32; what that leaves is computed.
    """
    theta, shift = 1.0 - t, 0 if same else len(a.ids)
    group = _fold_groups(b.k if same else np.concatenate([a.k, b.k]), a.dim)
    fa = _Folded(a, group)
    fb = fa if same else _Folded(b, group)
    margin = (fa.width + 16) * 1.2e-7
    comp = np.arange(len(a.ids) if same else len(a.ids) + len(b.ids))
    for at in range(0, len(b.tiles), FOLD_HELD):
        block = range(at, min(at + FOLD_HELD, len(b.tiles)))
        for m in range(block[-1] + 1 if same else len(a.tiles)):
            X, p = None, a.tiles[m]
            for n in range(max(m, at) if same else at, block[-1] + 1):
                q = b.tiles[n] + shift
                if (comp[p] == comp[p[0]]).all() and (comp[q] == comp[p[0]]).all():
                    continue
                sx, sy = fa.reach(m, fb.used[n]), fb.reach(n, fa.used[m])
                r = np.flatnonzero(sx * sy.max() >= theta - 1e-6)
                c = np.flatnonzero(sy * sx[r].max(initial=0.0) >= theta - 1e-6)
                if not len(r) or not len(c):
                    continue
                la, lb = comp[p[r]], comp[q[c]]
                names, size = np.unique(lb, return_counts=True)
                most = names[np.argmax(size)]
                for u, w in ((la != most, np.ones(len(c), dtype=bool)), (la == most, lb != most)):
                    rows, cols = r[u], c[w]
                    if not len(rows) or not len(cols):
                        continue
                    i, j = np.nonzero(fa.folded(m)[rows] @ fb.folded(n)[cols].T > theta - margin)
                    i, j = rows[i], cols[j]
                    parts = -(-len(i) // FOLD_CHUNK)
                    for part in range(parts):  # each part connects rows, and leaves less of the next ones to compute
                        x, y = i[part::parts], j[part::parts]
                        other = comp[p[x]] != comp[q[y]]
                        x, y = x[other], y[other]
                        if not len(x):
                            continue
                        X = fa.dense(m) if X is None else X
                        near = 1.0 - fb.products(X, x, n, y) < t
                        comp = _merge(comp, p[x[near]], q[y[near]])
    return comp


GROUP_TILES = 16  # tiles of ``block_rows`` rows in a shuffled group, if there are tasks enough
GROUP_CELLS = 1 << 24  # the same for sparse vectors, whose rows are small: 12 bytes a cell as a task holds them


def _n_groups(n_rows: int, block_rows: int, parallelism: int, n_cells: int | None = None) -> int:
    """Groups of vectors: a vector is sent to each of them, so there are as few as
    ``GROUP_TILES`` tiles (``GROUP_CELLS``, of sparse vectors with ``n_cells``) a group
    allow, and more only to occupy every core."""
    least = n_blocks_for(n_rows, block_rows * GROUP_TILES)
    if n_cells is not None:  # rows of few cells: at most 16 times as many
        least = max(math.ceil(n_cells / GROUP_CELLS), n_blocks_for(n_rows, block_rows * GROUP_TILES * 16))
    return min(n_blocks_for(n_rows, block_rows), max(least, math.ceil(2 * math.sqrt(parallelism))))


def _score_rows(fn, ia, X, ib, Y, r, c, chunk: int = 1 << 16):
    """``i < j`` and ``fn`` of the rows of each pair; an id with several rows has a value for each."""
    if len(np.unique(ia)) < len(ia) or len(np.unique(ib)) < len(ib):
        both = pd.DataFrame({"i": ia[r], "j": ib[c]}).merge(
            pd.DataFrame({"i": ia, "r": np.arange(len(ia))}), on="i").merge(
            pd.DataFrame({"j": ib, "c": np.arange(len(ib))}), on="j")
        r, c = both["r"].to_numpy(), both["c"].to_numpy()
    lo = ia[r] <= ib[c]
    out = [np.empty(0)]
    for s in range(0, len(r), chunk):
        a, b, first = X[r[s:s + chunk]], Y[c[s:s + chunk]], lo[s:s + chunk, None]
        out.append(np.asarray(fn(np.where(first, a, b), np.where(first, b, a)), dtype=np.float64))
    return np.minimum(ia[r], ib[c]), np.maximum(ia[r], ib[c]), np.concatenate(out)


def dense_pairs(vectors: DataFrame, metric: str = "cosine", t: float | None = None,
                id_col: str = "vec_id", vec_col: str = "embedding",
                block_rows: int = 1024, n_rows: int | None = None,
                inclusive: bool = False, kind: str = "dense", dim: int | None = None,
                forest: bool = False, score=None, n_cells: int | None = None) -> DataFrame:
    """N3 (blocked): ``i < j, dist`` for all pairs, or those under ``t``.

    ``kind='sparse'`` takes ``map<idx, w>`` vectors with ``0 <= idx < dim``
    (a cut vocabulary) and densifies them per tile. ``inclusive`` keeps
    ``dist <= t``. ``forest`` keeps only a spanning forest of each group pair's
    edges as stars (dist null): the same connected components from
    O(n * groups) edges. ``score(X, Y)`` replaces the distances of the pairs kept.

    A task holds two groups of up to ``GROUP_TILES`` * ``block_rows`` vectors (sparse ones:
    about ``GROUP_CELLS`` cells, ``n_cells`` in all) and goes
    through their tiles of ``block_rows``, so a vector is shuffled once per group,
    not once per tile, and no matrix is larger than a tile pair. Results leave
    the task tile by tile.
    """
    if forest and t is None:
        raise ValueError("a forest needs a threshold")
    if kind != "dense" and n_cells is None:
        n_rows, n_cells = vectors.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.size(vec_col)), F.lit(0))).first()
    if n_rows is None:
        n_rows = vectors.count()
    nb = _n_groups(n_rows, block_rows, vectors.sparkSession.sparkContext.defaultParallelism, n_cells)
    if kind != "dense" and (dim is None or score is not None):
        raise ValueError("sparse vectors need their dimension and take no score")
    # unequal cells take a pass over both rows: sparse pairs are screened as sets, which are never farther apart
    screen = "jaccard_set" if kind != "dense" and metric in ("jaccard", "jaccard_binary") else metric
    if forest and screen != metric:
        raise ValueError(f"no forest of sparse vectors by {metric}")

    def tile_pairs(a: _Side, b: _Side, same: bool):
        for block in b.blocks():
            for m in range(block[-1] + 1 if same else len(a.tiles)):
                x = a.rows(m)
                for n in range(max(m, block[0]) if same else block[0], block[-1] + 1):
                    yield m, n, x, b.rows(n, held=True)

    def stars(a: _Side, b: _Side, same: bool) -> pd.DataFrame:
        ids = a.ids if same else np.concatenate([a.ids, b.ids])
        if a.sparse and metric == "cosine" and t < 1:  # from t = 1 on, rows without a common column are close
            return star_rows(ids, _cosine_labels(a, b, same, t))
        comp, shift = np.arange(len(ids)), 0 if same else len(a.ids)
        for block in b.blocks():
            for m in range(block[-1] + 1 if same else len(a.tiles)):
                x = None
                for n in range(max(m, block[0]) if same else block[0], block[-1] + 1):
                    p, q = a.tiles[m], b.tiles[n] + shift
                    if (comp[p] == comp[p[0]]).all() and (comp[q] == comp[p[0]]).all():
                        continue
                    x = x or a.rows(m)
                    y = b.rows(n, held=True)
                    r, c = _may_be_close(x, y, metric, t)
                    if not len(r) or not len(c):
                        continue
                    for i, j in _forest_cells(x, y, r, c, comp[p[r]], comp[q[c]], metric, t, a.sparse):
                        comp = _merge(comp, p[i], q[j])
        return star_rows(ids, comp)

    def star_rows(ids: np.ndarray, comp: np.ndarray) -> pd.DataFrame:
        least = pd.Series(ids).groupby(comp).transform("min").to_numpy()
        keep = least != ids
        return pd.DataFrame({"i": least[keep], "j": ids[keep], "dist": np.full(int(keep.sum()), np.nan)})

    def close(a: _Side, b: _Side, same: bool):
        for m, n, x, y in tile_pairs(a, b, same):
            ia, ib = a.ids[a.tiles[m]], b.ids[b.tiles[n]]
            r, c = _may_be_close(x, y, screen, t)
            if not len(r) or not len(c):
                continue
            X, Y, ia, ib = x.X[r], y.X[c], ia[r], ib[c]
            D = _dist_matrix(X, Y, screen)
            keep = np.ones(D.shape, dtype=bool) if t is None else D <= t + 1e-7  # a margin; exact values decide below
            if same and m == n:
                keep &= ia[:, None] < ib[None, :]
            elif same:
                keep &= ia[:, None] != ib[None, :]
            rr, cc = np.nonzero(keep)
            d = _pair_values(D, X, Y, rr, cc, metric, exact=screen != metric)
            if t is not None:
                ok = (d <= t) if inclusive else (d < t)
                rr, cc, d = rr[ok], cc[ok], d[ok]
            i, j = ia[rr], ib[cc]
            yield np.minimum(i, j), np.maximum(i, j), d, a.tiles[m][r[rr]], b.tiles[n][c[cc]]

    def run(key: tuple[Any, ...], frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ba, bb = key[0], key[1]
        parts = {ba: [], bb: []}
        for frame in frames:
            for own, part in frame.groupby("own"):
                parts[own].append(_packed(part))
        if not parts[ba] or not parts[bb]:
            return
        a = _Side(parts.pop(ba), block_rows, dim, screen)
        b = a if ba == bb else _Side(parts.pop(bb), block_rows, dim, screen)
        if forest:
            yield stars(a, b, ba == bb)
            return
        for i, j, d, r, c in close(a, b, ba == bb):
            if score is not None:
                i, j, d = _score_rows(score, a.ids, a.X, b.ids, b.X, r, c)
            yield pd.DataFrame({"i": i, "j": j, "dist": d})

    return _block_input(vectors, id_col, vec_col, nb, kind).groupBy("ba", "bb").applyInPandas(
        run, "i long, j long, dist double")


def _row_best(D: np.ndarray, k: int, ids: np.ndarray, X: np.ndarray, Y: np.ndarray, metric: str):
    """Rows, columns and distances of each row's ``k`` nearest by (distance, id).

    ``D`` comes from matrix products and only screens: every cell that rounding
    could hide among the ``k`` best is computed directly, then the cut is made.
    A sum of n products is off by at most n * eps / 2 of the sum of their sizes
    (to first order); the margins are several times that.
    """
    none = np.array([], dtype=int)
    if not D.size:
        return none, none, np.array([])
    eps = np.finfo(np.float64).eps * (X.shape[1] + 8)
    if metric in ("euclidean", "sqeuclidean"):
        S = D * D if metric == "euclidean" else D
        margin = 4 * eps * ((X * X).sum(1) + (Y * Y).sum(1).max())
    else:
        S, margin = D, np.full(len(X), 4 * eps if metric == "cosine" else 0.0)
    S = np.where(np.isfinite(D), S, np.inf)
    kth = np.partition(S, k - 1, axis=1)[:, k - 1] if S.shape[1] > k else np.full(len(S), np.inf)
    rows, cols = np.nonzero((S <= (kth + 2 * margin)[:, None]) & np.isfinite(S))
    d = _pair_values(D, X, Y, rows, cols, metric, exact=metric == "cosine")
    order = np.lexsort((ids[cols], d, rows))
    rows, cols, d = rows[order], cols[order], d[order]
    keep = np.arange(len(rows)) - np.searchsorted(rows, rows) < k
    return rows[keep], cols[keep], d[keep]


def nearest(vectors: DataFrame, metric: str = "cosine", id_col: str = "vec_id",
            vec_col: str = "embedding", block_rows: int = 2048,
            n_rows: int | None = None, k: int = 1) -> DataFrame:
    """For each vector its ``k`` nearest others (``i, j, dist, rank``).

    Ties go to the smaller ``j``. Each block pair keeps only its per-row best
    ``k`` in both directions; the final top-k per ``i`` merges them.
    """
    if n_rows is None:
        n_rows = vectors.count()
    nb = n_blocks_for(n_rows, block_rows)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        same, ia, X, ib, Y = _split(pdf)
        D = _dist_matrix(X, Y, metric)
        if same:
            np.fill_diagonal(D, np.inf)
        r, c, d = _row_best(D, k, ib, X, Y, metric)
        i, j = ia[r], ib[c]
        if not same:
            r2, c2, d2 = _row_best(D.T, k, ia, Y, X, metric)
            i = np.concatenate([i, ib[r2]])
            j = np.concatenate([j, ia[c2]])
            d = np.concatenate([d, d2])
        return pd.DataFrame({"i": i, "j": j, "dist": d})

    cand = _block_input(vectors, id_col, vec_col, nb).groupBy("ba", "bb").applyInPandas(
        run, "i long, j long, dist double")
    w = Window.partitionBy("i").orderBy("dist", "j")
    return cand.dropDuplicates(["i", "j"]).withColumn("rank", F.row_number().over(w)) \
        .where(F.col("rank") <= k)


def square_form(pairs: DataFrame, ids: DataFrame | None = None, id_col: str = "unit_id") -> DataFrame:
    """Condensed ``i < j`` -> both directions, plus a zero diagonal."""
    both = pairs.select("i", "j", "dist").unionByName(
        pairs.select(F.col("j").alias("i"), F.col("i").alias("j"), "dist"))
    if ids is not None:
        diag = ids.select(F.col(id_col).alias("i"), F.col(id_col).alias("j"),
                          F.lit(0.0).alias("dist"))
        both = both.unionByName(diag)
    return both


def user_metric_pairs(pairs: DataFrame | None, vectors: DataFrame, fn, id_col: str = "vec_id",
                      vec_col: str = "embedding", within: tuple[str, float] | None = None) -> DataFrame:
    """Score given pairs with a caller-supplied ``fn(X, Y) -> distances``.

    ``fn`` takes two aligned 2-d numpy arrays and returns one value per row;
    it runs as an Arrow-batched pandas UDF. Instead of ``pairs``, ``within`` names the
    pairs below a distance, as (metric, t): they are scored in the tasks that
    find them, and neither they nor two vectors for each are shuffled.
    """
    if (pairs is None) == (within is None):
        raise ValueError("either pairs or within")
    if within is not None:
        return dense_pairs(vectors, *within, id_col=id_col, vec_col=vec_col, score=fn)

    @F.pandas_udf("double")
    def score(a: pd.Series, b: pd.Series) -> pd.Series:
        X = np.array(a.tolist(), dtype=np.float64)
        Y = np.array(b.tolist(), dtype=np.float64)
        return pd.Series(np.asarray(fn(X, Y), dtype=np.float64))

    v = vectors.select(F.col(id_col), F.col(vec_col).cast("array<double>").alias("__v"))
    vi = v.select(F.col(id_col).alias("i"), F.col("__v").alias("vi"))
    vj = v.select(F.col(id_col).alias("j"), F.col("__v").alias("vj"))
    return pairs.select("i", "j").join(vi, "i").join(vj, "j").select(
        "i", "j", score("vi", "vj").alias("dist"))


def cross_nearest(queries: DataFrame, refs: DataFrame, k: int = 5, metric: str = "euclidean",
                  id_col: str = "vec_id", vec_col: str = "embedding", block_rows: int = 1024,
                  n_queries: int | None = None, n_refs: int | None = None) -> DataFrame:
    """M4's search: for each query vector its ``k`` nearest reference vectors.

    Query blocks x reference blocks, one task per block pair; each task keeps
    the per-query best ``k``, the final top-k per query merges them
    (ties to the smaller reference id). ``i, j, dist, rank``.
    """
    nq = n_blocks_for(n_queries if n_queries is not None else queries.count(), block_rows)
    nr = n_blocks_for(n_refs if n_refs is not None else refs.count(), block_rows)

    def side(df, name, own_n, other_n, own_first):
        own = F.pmod(F.xxhash64(F.col(id_col)), F.lit(own_n)).cast("int")
        x = df.select(F.col(id_col).cast("long").alias("id"),
                      F.col(vec_col).cast("array<double>").alias("v"), own.alias("own"))
        x = x.withColumn("other", F.explode(F.sequence(F.lit(0), F.lit(other_n - 1))))
        bq, br = (F.col("own"), F.col("other")) if own_first else (F.col("other"), F.col("own"))
        return x.select(bq.alias("bq"), br.alias("br"), F.lit(name).alias("side"), "id", "v")

    both = side(queries, "q", nq, nr, True).unionByName(side(refs, "r", nr, nq, False))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        q = pdf[pdf["side"] == "q"]
        r = pdf[pdf["side"] == "r"]
        if len(q) == 0 or len(r) == 0:
            return pd.DataFrame({"i": [], "j": [], "dist": []})
        Q = np.array(q["v"].tolist(), dtype=np.float64).reshape(len(q), -1)
        R = np.array(r["v"].tolist(), dtype=np.float64).reshape(len(r), -1)
        qi, rj = q["id"].to_numpy(), r["id"].to_numpy()
        D = _dist_matrix(Q, R, metric)
        rows, cols, d = _row_best(D, k, rj, Q, R, metric)
        return pd.DataFrame({"i": qi[rows], "j": rj[cols], "dist": d})

    cand = both.groupBy("bq", "br").applyInPandas(run, "i long, j long, dist double")
    w = Window.partitionBy("i").orderBy("dist", "j")
    return cand.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
