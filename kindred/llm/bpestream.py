"""BPE encoding and decoding as streaming transducers with bounded lookahead.

*Encoding.* A text arrives in chunks. It is cut into the pieces of the
byte-level split, and merges never cross pieces. A piece that the text's chunk
ends in may still grow, so the last two pieces of a chunk wait for the next
one; a piece that grows beyond ``LONG`` characters is handed on byte by byte
without waiting for its end.

Within a piece, a boundary between two tokens is stable once enough bytes
behind it are known. How many are enough follows from the merge list
(``lookahead``): whether rule ``(u, v)`` applies is decided by what follows
only if an earlier rule takes the end of ``v`` away, as the left part of its
own pair; that rule in turn may be hindered by a still earlier one at its right
end, and so on. Rules get strictly earlier along such a chain, so the longest
reach is one pass over the list. ``ByteStream`` merges a bounded buffer and emits the
tokens that end that many bytes before the buffer's end; those are the tokens
of every continuation.

*Decoding.* Each id stands for bytes; an incremental UTF-8 state machine turns
them into text, holding at most an incomplete character between chunks.

Both keep memory that does not depend on the text's length; of the pieces already
encoded, at most two times ``max_pieces`` are kept.
"""

from __future__ import annotations

import codecs
import functools
import heapq
import itertools
import json
import re
import unicodedata

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as Ty

SLICE = 1 << 16  # characters of a text fed at once
LONG = 4096      # a piece longer than this is streamed before its end is seen
FAR = 1 << 60

# The bytes that byte-level vocabularies write as themselves (the
# others are written as the characters from U+0100 on), and the contractions
# and white space of their split.
PLAIN_BYTES = [*range(33, 127), *range(161, 173), *range(174, 256)]
CONTRACTIONS = "'(?:[stmd]|re|ve|ll)"
WHITE = "\\x09-\\x0D\\x20\\x85\\xA0\\u1680\\u2000-\\u200A\\u2028\\u2029\\u202F\\u205F\\u3000"


def byte_names() -> dict[str, int]:
    """Vocabulary character -> byte."""
    rest = [b for b in range(256) if b not in set(PLAIN_BYTES)]
    return {chr(b): b for b in PLAIN_BYTES} | {chr(256 + i): b for i, b in enumerate(rest)}


def lookahead(merges: list[tuple[bytes, bytes]]) -> int:
    """Bytes that must follow a boundary before no later byte can undo it.

    ``reach[t]`` is how far behind the start of a merge's right part a rule
    with left part ``t`` looks; ``hindered[t]`` how far behind the end of
    ``t`` the bytes lie that can keep ``t`` from being made.
    """
    reach, hindered, most = {}, {}, 0
    for u, v in merges:
        if (len(u) > 1 and u not in hindered) or (len(v) > 1 and v not in hindered):
            raise ValueError("a merge uses a token that no earlier merge makes")
        if u + v in hindered:
            raise ValueError("two merges make the same token")
        h = hindered[u + v] = max(reach.get(v, 0), hindered.get(v, 0))
        reach[u] = max(reach.get(u, 0), len(v) + h)
        most = max(most, len(v) + h)
    return most


@functools.cache
def codec(path: str, encodes: bool = True) -> Codec:
    """The worker process's tables, loaded once; a decoder needs few of them."""
    return Codec(path, encodes=encodes)


class Codec:
    """Tables of one byte-level vocabulary file."""

    def __init__(self, path: str, max_pieces: int = 150_000, encodes: bool = True):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        split, model = spec["pre_tokenizer"], spec["model"]
        if spec["normalizer"] or split["type"] != "ByteLevel" or split["add_prefix_space"] or not split["use_regex"]:
            raise ValueError("not a byte-level vocabulary without normaliser")
        names = byte_names()
        as_bytes = {name: bytes(map(names.__getitem__, name)) for name in model["vocab"]}
        ids = model["vocab"]
        self.size = max([*ids.values(), *(t["id"] for t in spec["added_tokens"])]) + 1
        self.bytes = [b""] * self.size
        for name, i in ids.items():
            self.bytes[i] = as_bytes[name]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        for content, i in self.special.items():
            self.bytes[i] = content.encode()
        self.dtype = np.dtype("<u2" if self.size <= 1 << 16 else "<u4")
        if encodes:
            self._load_rules(path, model, as_bytes, names)
        self.max_pieces = max_pieces
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def _load_rules(self, path, model, as_bytes, names):
        ids = model["vocab"]
        pairs = [tuple(m) if not isinstance(m, str) else tuple(m.split(" ")) for m in model["merges"]]
        self.rank = {(ids[u], ids[v]): r for r, (u, v) in enumerate(pairs)}
        self.made = [ids[u + v] for u, v in pairs]
        self.of_byte = [0] * 256
        for name, b in names.items():
            self.of_byte[b] = ids[name]
        self.lookahead = lookahead([(as_bytes[u], as_bytes[v]) for u, v in pairs])
        self.longest_special = max(map(len, self.special), default=0)
        by_length = sorted(self.special, key=len, reverse=True)
        self.find_special = re.compile("|".join(map(re.escape, by_length))).finditer if by_length else None
        letters, digits = character_classes(path)
        self.runs = [re.compile(f"[{c}]*") for c in (WHITE, ranges(letters), ranges(digits))]
        self.runs.append(re.compile(f"[^{WHITE}{ranges(letters)}{ranges(digits)}]*"))
        # A class costs its ranges wherever it fails, so texts of few planes get shorter ones.
        self.findall = []
        for top in (0x80, 0x10000, 0x110000):
            w, x, y = WHITE, *(ranges([c for c in kind if c < top]) for kind in (letters, digits))
            self.findall.append(re.compile(f"{CONTRACTIONS}| ?[{x}]+| ?[{y}]+| ?[^{w}{x}{y}]+|"
                                           f"[{w}]+(?![^{w}])|[{w}]+").findall)

    def pieces(self, text: str) -> list[str]:
        """The byte-level split of a text."""
        if text.isascii():
            return self.findall[0](text)
        return self.findall[1 if len(text.encode("utf-16-le")) == 2 * len(text) else 2](text)

    def merge(self, data: bytes) -> list[int]:
        """Ids of ``data`` as one piece: always the earliest rule, leftmost first."""
        ids = list(map(self.of_byte.__getitem__, data))
        if len(ids) > 256:
            return self._merge_long(ids)
        get, made = self.rank.get, self.made
        ranks = [get(p, FAR) for p in zip(ids, ids[1:])]
        while ranks:
            r = min(ranks)
            if r == FAR:
                break
            i = ranks.index(r)
            ids[i] = made[r]
            del ids[i + 1], ranks[i]
            if i < len(ranks):
                ranks[i] = get((ids[i], ids[i + 1]), FAR)
            if i:
                ranks[i - 1] = get((ids[i - 1], ids[i]), FAR)
        return ids

    def _merge_long(self, ids: list[int]) -> list[int]:
        get, made, n = self.rank.get, self.made, len(ids)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(r, i, p) for i, p in enumerate(zip(ids, ids[1:])) if (r := get(p)) is not None]
        heapq.heapify(heap)
        while heap:
            r, i, pair = heapq.heappop(heap)
            j = after[i]
            if ids[i] != pair[0] or j >= n or ids[j] != pair[1]:
                continue
            ids[i], ids[j] = made[r], -1
            k = after[i] = after[j]
            if k < n:
                before[k] = i
                if (s := get(q := (ids[i], ids[k]))) is not None:
                    heapq.heappush(heap, (s, i, q))
            h = before[i]
            if h >= 0 and (s := get(q := (ids[h], ids[i]))) is not None:
                heapq.heappush(heap, (s, h, q))
        return [i for i in ids if i >= 0]

    def packed(self, ids: list[int]) -> bytes:
        return np.array(ids, self.dtype).tobytes()

    def encode_pieces(self, pieces: list[str]) -> bytes:
        known = self.known
        got = list(map(known.get, pieces))
        if None in got:
            if len(known) > self.max_pieces:  # what is in use comes back from the older half
                self.older, known = known, {}
                self.known = known
            older = self.older.get
            for i, (piece, ids) in enumerate(zip(pieces, got)):
                if ids is None:
                    ids = known.get(piece) or older(piece) or self.packed(self.merge(piece.encode()))
                    if len(piece) <= 64:
                        known[piece] = ids
                    got[i] = ids
        return b"".join(got)

    def encode_stream(self, chunks):
        """Packed ids, as they become stable, of a text that comes in chunks."""
        pieces, held = PieceStream(self), ""
        for chunk in chunks:
            held = yield from self._between_specials(pieces, held + chunk, False)
        yield from self._between_specials(pieces, held, True)

    def _between_specials(self, pieces, text, last):
        """Feeds what no special token can start in; returns the rest."""
        at, end = 0, len(text) if last or not self.special else len(text) - self.longest_special + 1
        for m in self.find_special(text) if self.find_special else ():
            if not last and m.start() >= end:
                break
            yield pieces.feed(text[at:m.start()])
            yield pieces.finish()
            yield self.packed([self.special[m.group()]])
            at = m.end()
        end = max(at, end)
        yield pieces.feed(text[at:end])
        if last:
            yield pieces.finish()
        return text[end:]

    def encode(self, text: str) -> np.ndarray:
        chunks = (text[i:i + SLICE] for i in range(0, len(text), SLICE))
        return np.frombuffer(b"".join(self.encode_stream(chunks)), self.dtype)

    def decode_stream(self, chunks):
        """Text of ids that come in chunks, as its characters become complete."""
        state, table = codecs.getincrementaldecoder("utf-8")("replace"), self.bytes
        for ids in chunks:
            yield state.decode(b"".join([table[i] if 0 <= i < self.size else b"" for i in ids]))
        yield state.decode(b"", final=True)

    def decode(self, ids: np.ndarray) -> str:
        chunks = (ids[i:i + SLICE].tolist() for i in range(0, len(ids), SLICE))
        return "".join(self.decode_stream(chunks))


class PieceStream:
    """Cuts a growing text into pieces and gives their ids once they are sure."""

    def __init__(self, codec: Codec):
        self.codec, self.tail = codec, ""
        self.open, self.run, self.white = None, None, ""

    def feed(self, text: str) -> bytes:
        out = b""
        if self.open:
            out, text = self._grow(text)
        if not text:
            return out
        found = self.codec.pieces(self.tail + text)
        last = found[-2:]
        del found[-2:]
        if sum(map(len, last)) > LONG and len(last) == 2:
            found.append(last.pop(0))  # no apostrophe before one or two letters, so sure
        self.tail = "".join(last)
        out += self.codec.encode_pieces(found)
        if len(self.tail) > LONG:
            out += self._start(self.tail)
        return out

    def _start(self, piece: str) -> bytes:
        self.open, self.tail = ByteStream(self.codec), ""
        runs = self.codec.runs
        self.run = next(r for r in runs if r.fullmatch(piece[-1]))
        return self._push(piece)

    def _push(self, text: str) -> bytes:
        """White space keeps its last character: it goes with a word behind it."""
        if self.run is self.codec.runs[0]:
            text, self.white = text[:-1], text[-1:]
        return self.open.push(text.encode())

    def _grow(self, text: str) -> tuple[bytes, str]:
        text, self.white = self.white + text, ""
        n = self.run.match(text).end()
        if n == len(text):
            return self._push(text), ""
        if self.run is self.codec.runs[0]:
            n -= 1
        out = self.open.push(text[:n].encode()) + self.open.finish()
        self.open = None
        return out, text[n:]

    def finish(self) -> bytes:
        if self.open:
            out = self.open.push(self.white.encode()) + self.open.finish()
        else:
            out = self.codec.encode_pieces(self.codec.pieces(self.tail))
        self.open, self.white, self.tail = None, "", ""
        return out


class ByteStream:
    """Ids of one piece whose bytes come in parts; buffers a bounded number."""

    def __init__(self, codec: Codec):
        self.codec, self.held = codec, b""

    def push(self, data: bytes) -> bytes:
        self.held += data
        sure = len(self.held) - self.codec.lookahead
        if sure < LONG:
            return b""
        ids = self.codec.merge(self.held)
        ends = list(itertools.accumulate(len(self.codec.bytes[i]) for i in ids))
        n = int(np.searchsorted(ends, sure, side="right"))
        self.held = self.held[ends[n - 1]:]
        return self.codec.packed(ids[:n])

    def finish(self) -> bytes:
        ids = self.codec.merge(self.held)
        self.held = b""
        return self.codec.packed(ids)


def character_classes(path: str) -> tuple[list[int], list[int]]:
    """Letters and digits as the library's split sees them.

    From this Python's Unicode tables; characters these do not know yet are
    put to the library, which may know them.
    """
    import regex
    kinds = [unicodedata.category(chr(c))[0] for c in range(0x110000)]
    newer = [c for c in map(ord, regex.findall(r"\P{Cn}", "".join(
        chr(c) for c, k in enumerate(kinds) if k == "C" and unicodedata.category(chr(c)) == "Cn")))]
    for lead, kind in (("a", "L"), ("1", "N")):
        for c in joined_by_the_library(path, lead, newer):
            kinds[c] = kind
    return tuple([c for c, k in enumerate(kinds) if k == kind] for kind in "LN")


def joined_by_the_library(path: str, lead: str, points: list[int]) -> list[int]:
    """Those characters that the library's split keeps together with ``lead``."""
    from tokenizers import Tokenizer
    split = Tokenizer.from_file(path).pre_tokenizer
    ends = {b for _, (_, b) in split.pre_tokenize_str("".join(f"\n{lead}{chr(c)}" for c in points))}
    return [c for i, c in enumerate(points) if 3 * i + 2 not in ends]


def ranges(points: list[int]) -> str:
    """Characters as the inside of a regex class."""
    out = []
    for _, run in itertools.groupby(enumerate(points), lambda p: p[1] - p[0]):
        run = [c for _, c in run]
        out.append(f"\\U{run[0]:08X}-\\U{run[-1]:08X}" if len(run) > 1 else f"\\U{run[0]:08X}")
    return "".join(out)


def _added(docs: DataFrame, keep, name: str, kind: Ty.DataType) -> tuple[list[str], Ty.StructType]:
    kept = [c for c in (docs.columns if keep is None else keep) if c != name]
    return kept, Ty.StructType([docs.schema[c] for c in kept] + [Ty.StructField(name, kind)])


def encode_texts(docs: DataFrame, path: str, text_col: str = "text", ids_col: str = "ids",
                 keep: list[str] | None = None) -> DataFrame:
    """``docs`` with ``ids_col``, the token ids of each whole text.

    Ids are the library's with ``add_special_tokens=False`` and no truncation
    or padding; names of special tokens in a text give their ids. ``keep``
    names the columns to keep (default: all). A null or empty text has no ids
    (an empty array); every row gives one row, repeated rows and null ids
    included; a column already called ``ids_col`` is replaced; an empty table
    gives an empty one. No shuffle: each row is encoded where it is read.
    """
    kept, schema = _added(docs, keep, ids_col, Ty.ArrayType(Ty.IntegerType()))

    def run(batches):
        import pyarrow as pa
        tables = codec(path)
        for batch in batches:
            for part in _parts(batch, "__text"):
                got = [tables.encode(t or "") for t in part.column(part.num_columns - 1).to_pylist()]
                offsets = np.cumsum([0, *map(len, got)]).astype(np.int32)
                flat = np.concatenate([*got, np.empty(0, tables.dtype)]).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [*part.columns[:-1], pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))],
                    names=[*kept, ids_col])

    return docs.select(*kept, F.col(text_col).cast("string").alias("__text")).mapInArrow(run, schema)


def decode_ids(docs: DataFrame, path: str, ids_col: str = "ids", text_col: str = "decoded",
               keep: list[str] | None = None) -> DataFrame:
    """``docs`` with ``text_col``, the text of each id array.

    As the library's ``decode(ids, skip_special_tokens=False)``: special tokens
    give their names, ids outside the vocabulary nothing, bytes that are no
    UTF-8 U+FFFD. Null ids give an empty text.
    """
    kept, schema = _added(docs, keep, text_col, Ty.StringType())

    def run(batches):
        import pyarrow as pa
        tables = codec(path, encodes=False)
        for batch in batches:
            for part in _parts(batch, "__ids"):
                ids = part.column(part.num_columns - 1)
                ends = ids.offsets.to_numpy()
                flat = ids.values.fill_null(-1).to_numpy(zero_copy_only=False)
                texts = [tables.decode(flat[a:b]) for a, b in zip(ends[:-1].tolist(), ends[1:].tolist())]
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], pa.array(texts, pa.string())],
                                                 names=[*kept, text_col])

    return docs.select(*kept, F.coalesce(F.col(ids_col).cast("array<int>"), F.array().cast("array<int>"))
                       .alias("__ids")).mapInArrow(run, schema)


def _parts(batch, name: str, most: int = 2 << 20):
    """Slices of an Arrow batch whose texts (id arrays) hold about ``most`` bytes (ids)."""
    import pyarrow as pa
    import pyarrow.compute as pc
    column = batch.column(name)
    length = pc.list_value_length if pa.types.is_list(column.type) else pc.binary_length
    sizes = pc.fill_null(length(column), 0).to_numpy().astype(np.int64)
    part = np.cumsum(sizes) // most
    cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), batch.num_rows]
    for a, b in zip(cuts, cuts[1:]):
        if b > a:
            yield batch.slice(a, b - a)
