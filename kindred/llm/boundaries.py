"""Token-id files with Elias-Fano encoded document boundaries.

All documents' ids, in ascending document order, form one long array. It is
stored in segments (rows of a Parquet table that every Spark reader can open):
a segment holds the packed ids of some documents and the end offsets of those
documents, Elias-Fano encoded against the segment's own start. A boundary costs
about ``2 + log2(ids / documents)`` bits instead of 64, and ``select`` finds any
one of them from a sampled directory without decoding the rest.

Documents are range-partitioned and sorted by id, so partitions follow one
another in the global array. A writer task knows how many ids of its own
partition precede a segment and stores that; what precedes the partition is a
sum over one row per partition, added on reading. No task or driver ever holds
a table of all boundaries.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from kindred.llm.common import whole_text

POPCOUNT = np.array([bin(i).count("1") for i in range(256)], np.uint8)
SAMPLE = 64  # every so many-th boundary has its byte in the directory

SEGMENT_SCHEMA = ("shard int, segment int, before long, n_docs int, n_tokens long, id_bytes int, "
                  "doc_ids array<bigint>, ids binary, ef_width int, ef_low binary, ef_high binary, "
                  "ef_directory binary")


@dataclass
class EliasFano:
    """A non-decreasing sequence of ``n`` values in ``[0, universe]``.

    The low ``width`` bits of each value are packed in ``low``. The rest is
    written in unary in ``high``: value i sets bit ``(v >> width) + i``.
    ``directory`` holds, for every ``SAMPLE``-th set bit, its byte and how many
    set bits precede that byte.
    """

    n: int
    width: int
    low: np.ndarray
    high: np.ndarray
    directory: np.ndarray

    @classmethod
    def encode(cls, values: np.ndarray, universe: int) -> EliasFano:
        v = np.asarray(values, np.int64)
        n = len(v)
        width = max(0, int(max(universe, 1) // max(n, 1)).bit_length() - 1)
        bits = (v[:, None] >> np.arange(width)) & 1
        low = np.packbits(bits.astype(np.uint8).ravel(), bitorder="little")
        ones = (v >> width) + np.arange(n)
        flags = np.zeros((int(ones[-1]) + 1) if n else 0, np.uint8)
        flags[ones] = 1
        high = np.packbits(flags, bitorder="little")
        at = ones[::SAMPLE] >> 3
        before = np.concatenate(([0], np.cumsum(POPCOUNT[high], dtype=np.int64)))[at] if n else at
        return cls(n, width, low, high, np.stack([at, before], 1).astype("<u4").ravel())

    @classmethod
    def load(cls, n: int, width: int, low: bytes, high: bytes, directory: bytes) -> EliasFano:
        return cls(n, width, np.frombuffer(low, np.uint8), np.frombuffer(high, np.uint8),
                   np.frombuffer(directory, "<u4"))

    def select(self, i: int) -> int:
        """Value number ``i`` (from 0), reading a few bytes after its sample."""
        if not 0 <= i < self.n:
            raise IndexError(i)
        byte, seen = (int(x) for x in self.directory[2 * (i // SAMPLE):2 * (i // SAMPLE) + 2])
        while seen + int(POPCOUNT[self.high[byte]]) <= i:
            seen += int(POPCOUNT[self.high[byte]])
            byte += 1
        word, bit = int(self.high[byte]), -1
        for _ in range(i - seen + 1):
            bit += 1
            while not word >> bit & 1:
                bit += 1
        return ((byte * 8 + bit - i) << self.width) | self._low(i)

    def _low(self, i: int) -> int:
        first, out = i * self.width, 0
        for k in range(self.width):
            out |= (int(self.low[(first + k) >> 3]) >> ((first + k) & 7) & 1) << k
        return out

    def all(self) -> np.ndarray:
        """Every value, in order."""
        ones = np.flatnonzero(np.unpackbits(self.high, bitorder="little"))[:self.n]
        bits = np.unpackbits(self.low, bitorder="little")[:self.n * self.width]
        low = bits.reshape(self.n, self.width).astype(np.int64) @ (1 << np.arange(self.width))
        return ((ones - np.arange(self.n)) << self.width) | low


def write_token_files(docs: DataFrame, path: str, vocabulary: str, end_id: int = 2,
                      id_col: str = "doc_id", text_col: str = "text",
                      segment_tokens: int = 1 << 18, segment_docs: int = 4096) -> None:
    """Encode every whole text and write the ids under ``path``.

    Null text is empty, and an empty text is the end id alone. Null ids come
    first; repeated rows are separate documents. A segment closes once it holds
    ``segment_tokens`` ids or ``segment_docs`` documents, so a task holds one
    segment and one document at most. An empty table writes no segments. Other
    columns are ignored, whatever their names.
    """
    d = docs.select(F.col(id_col).cast("long").alias("doc_id"), whole_text(text_col).alias("text"))
    # The hash spreads a repeated id over partitions; it orders ties the same way on each run.
    tie = F.xxhash64("text")
    d = d.repartitionByRange(F.col("doc_id").asc_nulls_first(), tie) \
        .sortWithinPartitions(F.col("doc_id").asc_nulls_first(), tie)

    def segments(batches):
        import pyarrow as pa

        from kindred.llm.tokens import encoder, sized_batches
        enc = encoder(vocabulary)
        end = np.array([end_id], enc.dtype).tobytes()
        shard, number, before = TaskContext.get().partitionId(), 0, 0
        ids, parts, n = [], [], 0

        def close():
            raw = b"".join(parts)
            ends = np.cumsum([len(p) for p in parts]) // enc.dtype.itemsize
            ef = EliasFano.encode(ends, n)
            row = dict(shard=shard, segment=number, before=before, n_docs=len(ids), n_tokens=n,
                       id_bytes=enc.dtype.itemsize, doc_ids=ids, ids=raw, ef_width=ef.width,
                       ef_low=ef.low.tobytes(), ef_high=ef.high.tobytes(),
                       ef_directory=ef.directory.tobytes())
            return pa.RecordBatch.from_pylist([row], ARROW)

        ARROW = pa.schema([("shard", pa.int32()), ("segment", pa.int32()), ("before", pa.int64()),
                           ("n_docs", pa.int32()), ("n_tokens", pa.int64()), ("id_bytes", pa.int32()),
                           ("doc_ids", pa.list_(pa.int64())), ("ids", pa.binary()), ("ef_width", pa.int32()),
                           ("ef_low", pa.binary()), ("ef_high", pa.binary()), ("ef_directory", pa.binary())])
        for doc_ids, texts in sized_batches(batches, "doc_id", "text"):
            for doc_id, packed in zip(doc_ids, enc.encode(texts)):
                ids.append(doc_id)
                parts.append(packed + end)
                n += len(packed) // enc.dtype.itemsize + 1
                if n >= segment_tokens or len(ids) >= segment_docs:
                    yield close()
                    number, before = number + 1, before + n
                    ids, parts, n = [], [], 0
        if ids:
            yield close()

    d.mapInArrow(segments, SEGMENT_SCHEMA).write.parquet(path)


def read_token_files(spark: SparkSession, path: str) -> DataFrame:
    """``doc_id, start, n_tokens, ids_crc32, ids`` per document, from the files alone.

    ``ids`` are little-endian, 2 or 4 bytes each (``id_bytes``); the crc is
    taken over them as 32-bit integers.
    """
    t = spark.read.parquet(path)
    # One row per written partition.
    shards = t.groupBy("shard").agg(F.sum("n_tokens").alias("n"))
    past = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    base = shards.select("shard", F.coalesce(F.sum("n").over(past), F.lit(0)).alias("base"))
    out = "doc_id long, start long, n_tokens long, ids_crc32 long, id_bytes int, ids binary"
    return t.join(F.broadcast(base), "shard").mapInArrow(_documents, out)


def _documents(batches):
    import pyarrow as pa
    schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()),
                        ("ids_crc32", pa.int64()), ("id_bytes", pa.int32()), ("ids", pa.binary())])
    for batch in batches:
        for k in range(batch.num_rows):
            row = {c: batch.column(c)[k].as_py() for c in batch.schema.names}
            ef = EliasFano.load(row["n_docs"], row["ef_width"], row["ef_low"], row["ef_high"],
                                row["ef_directory"])
            ends = ef.all()
            starts = np.concatenate(([0], ends))[:-1]
            width = row["id_bytes"]
            wide = np.frombuffer(row["ids"], f"<u{width}").astype("<u4")
            at = list(zip(starts.tolist(), ends.tolist()))
            yield pa.RecordBatch.from_arrays([
                pa.array(row["doc_ids"], pa.int64()),
                pa.array(row["base"] + row["before"] + starts, pa.int64()),
                pa.array(ends - starts, pa.int64()),
                pa.array([zlib.crc32(wide[a:b].tobytes()) for a, b in at], pa.int64()),
                pa.array([width] * len(at), pa.int32()),
                pa.array([row["ids"][a * width:b * width] for a, b in at], pa.binary())], schema=schema)
