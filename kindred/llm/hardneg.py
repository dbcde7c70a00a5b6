"""Hard negatives from exact integer scores of a residue-number-system product.

Vectors are scaled to integers. Their inner products are exact although the
work is float32 matrix products: each component is taken modulo several primes
below 512 (centred, so at most 255 in size), a product over at most 256
components then stays below 2^24 and float32 holds it exactly; the sums are
reduced modulo the prime, and Chinese remaindering gives the signed score from
its residues. As many primes are used as the largest possible score needs.

Vectors are packed into blocks of rows; the blocks of the anchors (the stated
query set) are sent to every lane of candidate blocks, candidates are never
copied. Two passes: the first finds each anchor's positives, the second takes for each of
them the best different-label rows inside its score window. A block pair
returns at most a few rows per anchor, so nothing grows beyond a block.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kindred.llm.common import stage
from kindred.session import shuffle_partitions

BLOCK = 2048      # rows of a block
CHUNK = 256       # components of one float32 product; 256 * 255^2 < 2^24
BELOW = 512       # primes stay below
LOW = np.iinfo(np.int64).min


def primes_for(bound: int) -> list[int]:
    """Primes below ``BELOW``, largest first, whose product passes ``2 * bound``."""
    sieve = [p for p in range(BELOW - 1, 1, -1) if all(p % q for q in range(2, int(p ** 0.5) + 1))]
    out, product = [], 1
    for p in sieve:
        if product > 2 * bound:
            break
        out.append(p)
        product *= p
    return out


def residues(x: np.ndarray, p: int) -> np.ndarray:
    """``x`` modulo ``p`` in ``-(p-1)/2 .. (p-1)/2`` as float32."""
    r = np.mod(x, p)
    return np.where(r > p // 2, r - p, r).astype(np.float32)


def exact_products(a: np.ndarray, b: np.ndarray, primes: list[int]) -> np.ndarray:
    """``a @ b.T`` of int64 matrices, exact where it is below half the primes' product.

    Chinese remaindering in mixed radix: the score is ``d0 + d1 p0 + d2 p0 p1 + ...``
    with centred digits, so no step passes the score's own size by much.
    """
    score, weight, digits = np.zeros((len(a), len(b)), np.int64), 1, []
    for k, p in enumerate(primes):
        rest = np.zeros((len(a), len(b)), np.int64)
        for c in range(0, a.shape[1], CHUNK):
            part = residues(a[:, c:c + CHUNK], p) @ residues(b[:, c:c + CHUNK], p).T
            rest += part.astype(np.int64)
        for d, q in zip(digits, primes):  # strip the digits known so far
            rest = np.mod(rest - d, p) * pow(q, -1, p)
        digit = np.mod(rest, p)
        digit = np.where(digit > p // 2, digit - p, digit)
        digits.append(digit)
        score += digit * weight
        weight *= p
    return score


def usable(vec_col: str):
    v = F.col(vec_col)
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return v.isNotNull() & ~F.coalesce(bad, F.lit(False))


def integer_vectors(vectors: DataFrame, scale: int = 256, id_col: str = "vec_id",
                    vec_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """``vec_id, label, q``: usable rows with ``q`` = floor(scale * x) as longs."""
    return vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(label_col).cast("long").alias("label"),
                          F.col(vec_col).cast("array<double>").alias("v")) \
        .where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & usable("v")) \
        .select("vec_id", "label", F.transform("v", lambda x: F.floor(x * F.lit(float(scale)))).alias("q"))


def packed_blocks(rows: DataFrame, dim: int) -> DataFrame:
    """``block, ids, labels, vectors``: up to ``BLOCK`` rows a block, by id; short vectors end in zeros."""
    schema = "block long, ids binary, labels binary, vectors binary"

    def pack(frames):
        import pandas as pd
        from pyspark import TaskContext
        part, number, held = TaskContext.get().partitionId(), 0, []

        def block(x):
            x = x.sort_values("vec_id", kind="stable")
            v = np.zeros((len(x), dim), np.int64)
            for row, q in zip(v, x["q"]):
                row[:len(q)] = q
            return pd.DataFrame([((part << 32) + number, x["vec_id"].to_numpy(np.int64).tobytes(),
                                  x["label"].to_numpy(np.int64).tobytes(), v.tobytes())],
                                columns=["block", "ids", "labels", "vectors"])

        for f in frames:
            held.append(f)
            if sum(map(len, held)) >= BLOCK:
                rows = pd.concat(held, ignore_index=True)
                while len(rows) >= BLOCK:
                    yield block(rows[:BLOCK])
                    number, rows = number + 1, rows[BLOCK:]
                held = [rows]
        rows = pd.concat(held, ignore_index=True) if held else []
        if len(rows):
            yield block(rows)

    return rows.mapInPandas(pack, schema)


def _matrix(ids: bytes, labels: bytes, vectors: bytes):
    ids = np.frombuffer(ids, np.int64)
    return ids, np.frombuffer(labels, np.int64), np.frombuffer(vectors, np.int64).reshape(len(ids), -1)


def _met(candidates: DataFrame, anchors: DataFrame) -> DataFrame:
    """Every anchor block beside every candidate block, in the candidates' lanes."""
    lanes = shuffle_partitions(candidates.sparkSession)
    c = candidates.withColumn("lane", F.pmod(F.xxhash64("block"), F.lit(lanes)).cast("int"))
    a = anchors.select(*[F.col(x).alias(f"anchor_{x}") for x in anchors.columns],
                       F.explode(F.sequence(F.lit(0), F.lit(lanes - 1))).alias("lane"))
    return c.join(a.hint("merge"), "lane")


def _positives(frames, primes, k):
    """The best ``k`` same-label rows of one block for each anchor row."""
    import pandas as pd
    for f in frames:
        for r in f.itertuples(index=False):
            ids, labels, x = _matrix(r.ids, r.labels, r.vectors)
            aid, alabel, a = _matrix(r.anchor_ids, r.anchor_labels, r.anchor_vectors)
            s = exact_products(a, x, primes)
            s[(aid[:, None] == ids) | (alabel[:, None] != labels)] = LOW
            best = np.argsort(~s, axis=1, kind="stable")[:, :k]  # descending, equal ones by id
            top = np.take_along_axis(s, best, axis=1)
            row, col = np.nonzero(top != LOW)
            yield pd.DataFrame({"anchor_block": r.anchor_block, "place": row.astype(np.int32),
                                "anchor_id": aid[row], "positive_id": ids[best[row, col]],
                                "positive_score": top[row, col]})


def _negatives(frames, primes, k):
    """Per anchor and positive, the block's best ``k`` different-label rows in the window."""
    import pandas as pd
    for f in frames:
        for r in f.itertuples(index=False):
            ids, labels, x = _matrix(r.ids, r.labels, r.vectors)
            aid, alabel, a = _matrix(r.anchor_ids, r.anchor_labels, r.anchor_vectors)
            place, turn, pid, score, low, high = (np.array(c, np.int64) for c in (
                r.anchor_places, r.anchor_turns, r.anchor_positives, r.anchor_scores, r.anchor_lows, r.anchor_highs))
            s = exact_products(a, x, primes)
            s[alabel[:, None] == labels] = LOW
            order = np.argsort(~s, axis=1, kind="stable")  # descending, equal ones by id
            s = np.take_along_axis(s, order, axis=1)
            out = []
            for at in np.unique(place):
                mine = np.flatnonzero(place == at)
                down = ~s[at]  # ascending
                starts = np.searchsorted(down, ~high[mine], side="left")
                ends = np.minimum(np.searchsorted(down, ~low[mine], side="right"), starts + k)
                for m, b, e in zip(mine.tolist(), starts.tolist(), ends.tolist()):
                    if e > b:
                        out.append((m, order[at, b:e], s[at, b:e]))
            if out:
                n = [len(o[1]) for o in out]
                m = np.repeat([o[0] for o in out], n)
                yield pd.DataFrame({
                    "anchor_block": r.anchor_block, "place": place[m].astype(np.int32),
                    "turn": turn[m].astype(np.int32), "anchor_id": aid[place[m]], "positive_id": pid[m], "positive_score": score[m],
                    "negative_id": ids[np.concatenate([o[1] for o in out])],
                    "negative_score": np.concatenate([o[2] for o in out])})


def mine(vectors: DataFrame, anchors, positives: int = 5, negatives: int = 3, low: int = 50, high: int = 95,
         scale: int = 256, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """``anchor_id, positive_id, rank, negative_id, positive_score, negative_score``.

    ``anchors`` is a condition on ``vec_id``. A score is the inner product of
    floor(scale * x); an anchor's positives are its first ``positives`` other
    rows of its label by score, ties to the smaller id; for each, the first
    ``negatives`` rows of another label whose score is between ``low`` and ``high``
    percent of the positive's (none below zero). Rows with a null id, label or vector, or a null
    or non-finite component, take no part. Other rows are those with another
    id; rows that repeat an id each take part, and a repeated anchor gives its
    rows once for each. A shorter vector counts as ending in zeros, an empty one
    is all zeros. Scores are exact longs; values whose scores could pass 2^56
    are refused. Other columns don't matter; an empty table gives no rows.
    """
    q = integer_vectors(vectors, scale, id_col, vec_col, label_col)
    size = q.agg(F.max(F.size("q")).alias("dim"), F.max(F.array_max(F.transform("q", lambda x: F.abs(x)))).alias("most"),
                 F.min(F.array_min("q")).alias("least")).first()
    dim, bound = size["dim"] or 1, (size["dim"] or 1) * int(size["most"] or 0) ** 2
    if bound >= 1 << 56 or (size["least"] is not None and size["least"] <= LOW):
        raise ValueError("scores of these vectors may pass 2^56; use a smaller scale")
    primes = primes_for(bound)
    blocks = stage(packed_blocks(q, dim), "hardneg-blocks")
    asked = stage(packed_blocks(q.where(anchors), dim), "hardneg-anchors")
    keys = ["anchor_block", "place"]

    first = _met(blocks, asked).mapInPandas(
        lambda f: _positives(f, primes, positives),
        "anchor_block long, place int, anchor_id long, positive_id long, positive_score long")
    order = Window.partitionBy(*keys).orderBy(F.desc("positive_score"), "positive_id")
    best = first.withColumn("n", F.row_number().over(order)).where(F.col("n") <= positives)
    # a block has at most BLOCK * positives of them; the window in whole numbers
    window = best.where("positive_score >= 0").select("anchor_block", F.struct(
        "place", F.col("n").alias("turn"), "positive_id", "positive_score",
        F.expr(f"({low} * positive_score + 99) div 100").alias("low"),
        F.expr(f"({high} * positive_score) div 100").alias("high")).alias("p")) \
        .groupBy("anchor_block").agg(F.collect_list("p").alias("p"))
    wanted = stage(asked.withColumnRenamed("block", "anchor_block").join(window, "anchor_block").select(
        F.col("anchor_block").alias("block"), "ids", "labels", "vectors", F.col("p.place").alias("places"), F.col("p.turn").alias("turns"),
        F.col("p.positive_id").alias("positives"), F.col("p.positive_score").alias("scores"),
        F.col("p.low").alias("lows"), F.col("p.high").alias("highs")), "hardneg-positives")

    second = _met(blocks, wanted).mapInPandas(
        lambda f: _negatives(f, primes, negatives),
        "anchor_block long, place int, turn int, anchor_id long, positive_id long, positive_score long, "
        "negative_id long, negative_score long")
    order = Window.partitionBy(*keys, "turn").orderBy(F.desc("negative_score"), "negative_id")
    return second.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= negatives) \
        .select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
