"""Packing along a space-filling curve.

A text becomes a hashed vector (counts of byte 4-grams in 256 signed buckets,
scaled to length 1), is projected to four fixed directions, and the four
coordinates become one Hilbert key. Documents are range-sorted by that key, so
neighbours on the curve have similar texts, and are laid end to end: the
corpus is one stream of ids cut every 2048 ids. Only the stream's tail is
shorter than a sequence; it is cut into powers of two, which need no padding.

The stream position of a document is its place inside its partition (stored
when the ids are written) plus what earlier partitions hold, one row per
partition. Cutting is then a row-wise matter and needs no order.
"""

from __future__ import annotations

import bisect
import zlib

import numpy as np
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kindred.llm.common import stage, whole_text
from kindred.session import shuffle_partitions

DIMS, BITS, BUCKETS = 4, 12, 256


def _directions() -> np.ndarray:
    signs = np.random.default_rng(20).choice([-1.0, 1.0], (BUCKETS, DIMS))
    return signs / np.sqrt(BUCKETS)


def text_vector(text: str) -> np.ndarray:
    """Unit vector of signed hashed byte 4-grams (zero for under four bytes)."""
    b = np.frombuffer(text.lower().encode(), np.uint8).astype(np.uint32)
    if len(b) < 4:
        return np.zeros(BUCKETS)
    with np.errstate(over="ignore"):
        g = (b[:-3] | b[1:-2] << np.uint32(8) | b[2:-1] << np.uint32(16) | b[3:] << np.uint32(24))
        h = g * np.uint32(0x9E3779B1)  # fixed value: a usual odd multiplier
    counts = np.bincount(h >> np.uint32(23), minlength=2 * BUCKETS).astype(float)
    v = counts[:BUCKETS] - counts[BUCKETS:]
    v = np.sign(v) * np.log1p(np.abs(v))
    return v / (np.linalg.norm(v) or 1.0)


def hilbert_keys(points: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Hilbert index of integer points (rows) on a grid of ``2**bits`` a side.

    Gray-code construction: walk the bits from the top, undoing the swap and
    the inversion that each level's sub-cube applies to the next.
    """
    x = points.astype(np.int64).T.copy()
    dims = len(x)
    top = 1 << (bits - 1)
    q = top
    while q > 1:
        low = q - 1
        for i in range(dims):
            inverted = (x[i] & q) > 0
            swap = np.where(inverted, 0, (x[0] ^ x[i]) & low)
            x[0] = np.where(inverted, x[0] ^ low, x[0] ^ swap)
            if i:
                x[i] ^= swap
        q >>= 1
    for i in range(1, dims):
        x[i] ^= x[i - 1]
    flip = np.zeros_like(x[0])
    q = top
    while q > 1:
        flip = np.where((x[dims - 1] & q) > 0, flip ^ (q - 1), flip)
        q >>= 1
    x ^= flip
    key = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for i in range(dims):
            key = (key << 1) | ((x[i] >> b) & 1)
    return key


def curve_keys(texts: list[str], directions: np.ndarray) -> np.ndarray:
    """Hilbert keys of texts. A unit vector's projections lie near 0, within
    a few times ``1 / sqrt(BUCKETS)``; that range is spread over the grid."""
    v = np.array([text_vector(t) for t in texts]).reshape(len(texts), BUCKETS) @ directions
    grid = np.clip((v * np.sqrt(BUCKETS) / 6 + 0.5) * (1 << BITS), 0, (1 << BITS) - 1)
    return hilbert_keys(grid.astype(np.int64))


def _placed(borders: list[tuple[int, int]]):
    """Key of a text and the number of its range; equal keys are told apart by ``tie``."""
    @F.pandas_udf("key long, part int")
    def placed(texts, ties):
        import pandas as pd
        keys = curve_keys(texts.tolist(), _directions())
        return pd.DataFrame({"key": keys, "part": [bisect.bisect_right(borders, p) for p in zip(keys.tolist(), ties)]})
    return placed


def _borders(d: DataFrame, per_part: int = 20) -> list[tuple[int, int]]:
    """Where the ranges meet: quantiles of a sample of about ``per_part`` rows a
    shuffle partition. Only the partitions' sizes depend on them, no result does."""
    parts = shuffle_partitions(d.sparkSession)
    rows = d.count()
    if parts < 2 or not rows:
        return []
    some = d.sample(min(1.0, per_part * parts / rows), seed=11) \
        .select(_placed([])(F.col("text"), F.col("tie"))["key"].alias("key"), "tie").collect()
    some = sorted((r["key"], r["tie"]) for r in some)
    return sorted({some[len(some) * k // parts] for k in range(1, parts)}) if some else []


def pack(docs: DataFrame, vocabulary: str, end_id: int = 1, length: int = 2048,
         id_col: str = "doc_id", text_col: str = "text", keep_ids: bool = False) -> DataFrame:
    """One row per piece: ``doc_id, start, length, ids_crc32, doc_tokens,
    sequence_id, offset, curve_key`` (and packed ``ids`` if asked for).

    Null text is empty; an empty text is the end id alone. Equal texts share a
    key and are told apart by a hash of their ids, so a text with very many
    copies spreads over partitions. Repeated rows are separate documents (null
    ids too). An empty table gives an empty result. Other columns are ignored,
    whatever their names.
    """
    d = docs.select(F.col(id_col).cast("long").alias("doc_id"), whole_text(text_col).alias("text"))

    tie = F.xxhash64("doc_id", F.col("doc_id").isNull())
    d = d.withColumn("tie", tie)
    borders = _borders(d)
    placed = _placed(borders)(F.col("text"), F.col("tie"))
    # Each key is computed once, where its text is read; the rows are then dealt by number.
    d = d.withColumn("p", placed).select("doc_id", "text", "tie", F.col("p.key").alias("curve_key"), F.col("p.part").alias("part")) \
        .repartitionById(len(borders) + 1, "part").sortWithinPartitions("curve_key", "tie", "doc_id") \
        .drop("tie", "part")

    def encoded(batches):
        import pyarrow as pa

        from kindred.llm.tokens import encoder, sized_batches
        enc = encoder(vocabulary)
        end = np.array([end_id], enc.dtype).tobytes()
        part, before = TaskContext.get().partitionId(), 0

        def keyed(stream):
            for b in stream:
                pairs = list(zip(b.column("doc_id").to_pylist(), b.column("curve_key").to_pylist()))
                yield pa.table({"key": pa.array(range(len(pairs))), "text": b.column("text")}).to_batches()[0] \
                    if pairs else b, pairs

        for batch, pairs in keyed(batches):
            if not pairs:
                continue
            for rows, texts in sized_batches([batch], "key", "text"):
                packed = [p + end for p in enc.encode(texts)]
                n = [len(p) // enc.dtype.itemsize for p in packed]
                at = before + np.concatenate(([0], np.cumsum(n)))
                before = int(at[-1])
                yield pa.RecordBatch.from_arrays([
                    pa.array([part] * len(n), pa.int32()), pa.array(at[:-1], pa.int64()),
                    pa.array([pairs[r][0] for r in rows], pa.int64()),
                    pa.array([pairs[r][1] for r in rows], pa.int64()),
                    pa.array(n, pa.int64()), pa.array([enc.dtype.itemsize] * len(n), pa.int32()),
                    pa.array(packed, pa.binary())],
                    names=["part", "before", "doc_id", "curve_key", "n", "id_bytes", "ids"])

    t = stage(d.mapInArrow(encoded, "part int, before long, doc_id long, curve_key long, n long, "
                                    "id_bytes int, ids binary"), "curve-tokens")
    parts = t.groupBy("part").agg(F.sum("n").alias("m"))  # one row per partition
    past = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    base = parts.select("part", F.coalesce(F.sum("m").over(past), F.lit(0)).alias("base"),
                        F.sum("m").over(Window.partitionBy()).alias("total"))
    schema = ("doc_id long, start long, length long, ids_crc32 long, doc_tokens long, "
              "sequence_id long, offset long, curve_key long" + (", ids binary" if keep_ids else ""))
    return t.join(F.broadcast(base), "part").mapInArrow(lambda b: _pieces(b, length, keep_ids), schema)


def stream_cuts(total: int, length: int) -> list[tuple[int, int]]:
    """``(position, size)`` of the tail's sequences: powers of two, largest first."""
    at, out = total - total % length, []
    for bit in range(length.bit_length() - 1, -1, -1):
        if (total % length) >> bit & 1:
            out.append((at, 1 << bit))
            at += 1 << bit
    return out


def _pieces(batches, length, keep_ids):
    import pyarrow as pa
    for batch in batches:
        cols = {c: batch.column(c).to_pylist() for c in batch.schema.names}
        out = []
        for i in range(batch.num_rows):
            first = cols["base"][i] + cols["before"][i]
            total, n, width, raw = cols["total"][i], cols["n"][i], cols["id_bytes"][i], cols["ids"][i]
            whole = total - total % length
            tail = stream_cuts(total, length) if first + n > whole else []
            at = first
            while at < first + n:
                if at < whole:
                    seq, begin, size = at // length, at - at % length, length
                else:
                    k = next(k for k, (p, s) in enumerate(tail) if p <= at < p + s)
                    seq, (begin, size) = whole // length + k, tail[k]
                take = min(first + n, begin + size) - at
                ids = raw[(at - first) * width:(at - first + take) * width]
                crc = zlib.crc32(np.frombuffer(ids, f"<u{width}").astype("<u4").tobytes())
                out.append((cols["doc_id"][i], at - first, take, crc, n, seq, at - begin,
                            cols["curve_key"][i], *([ids] if keep_ids else [])))
                at += take
        names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset",
                 "curve_key", *(["ids"] if keep_ids else [])]
        types = [pa.int64()] * 8 + [pa.binary()] * keep_ids
        columns = list(zip(*out)) or [[]] * len(names)
        yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, types)], names=names)
