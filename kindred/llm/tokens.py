"""Token ids of whole texts with the ``tokenizers`` library.

Both vocabularies split a text before merging, and no piece of that split
holds a space after a character that is not white space. Cutting a text before
such spaces therefore changes no id, and a cut-off chunk (mostly one word with
its leading space) has the same ids wherever it occurs. ``ChunkEncoder``
encodes each new chunk once per worker with the library and joins stored ids.
Texts that name a special token are encoded whole.
"""

from __future__ import annotations

import functools
import os
import re

import numpy as np

MARK = "\x01"
SPACE_NAME = "\u0120"  # fixed value: how byte-level vocabularies write a space
PUNCTUATION = "!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"
GROUP = 500  # chunks in one call's text
_BLANK_BEFORE_SPACE = re.compile(r"\s ")
_CUT = re.compile(r"(?<=\S)(?= )")


@functools.cache
def encoder(path: str) -> ChunkEncoder:
    """The worker process's encoder: what one task learns serves the next."""
    return ChunkEncoder(path)


def vocabulary_path(name: str) -> str:
    import public_tokenizers
    return public_tokenizers.path(name)


class ChunkEncoder:
    """Ids of texts as little-endian bytes, two per id if the vocabulary allows."""

    def __init__(self, path: str, max_chunks: int = 600_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # the task has one core
        from tokenizers import Tokenizer
        self.tok = Tokenizer.from_file(path)
        self.dtype = np.dtype("<u2" if self.tok.get_vocab_size() <= 1 << 16 else "<u4")
        self.max_chunks = max_chunks
        self.spaced: dict[str, bytes] = {}  # ids of " " + key
        self.mark = self.tok.encode(" " + MARK, add_special_tokens=False).ids
        names = [self.tok.id_to_token(i) or "" for i in range(self.tok.get_vocab_size())]
        suffix = self.tok.model.end_of_word_suffix
        self.ends = np.array([n.endswith(suffix) for n in names]) if suffix else None
        self.begins = np.array([n.startswith(SPACE_NAME) for n in names])
        self.tails: dict[str, bytes] = {}
        self.special = [t.content for t in self.tok.get_added_tokens_decoder().values()]

    def _encode(self, texts: list[str]) -> list[bytes]:
        got = self.tok.encode_batch_fast(texts, add_special_tokens=False)
        return [np.array(e.ids, self.dtype).tobytes() for e in got]

    def encode(self, texts: list[str]) -> list[bytes]:
        known = self.spaced
        if len(known) > self.max_chunks:
            known.clear()
        get, plans, heads, fresh = known.get, [], [], set()
        for text in texts:
            if any(s in text for s in self.special):
                heads.append(text)
                plans.append(([], None))
                continue
            if _BLANK_BEFORE_SPACE.search(text):
                first, *rest = _CUT.split(text)
                rest = [r[1:] for r in rest]
            else:
                first, *rest = text.split(" ")
            heads.append(first)
            parts = list(map(get, rest))
            if None in parts:
                missing = [c for c, p in zip(rest, parts) if p is None]
                fresh.update(missing)
                plans.append((parts, missing))
            else:
                plans.append((parts, None))
        self._learn(fresh)
        out = []
        for head, (parts, missing) in zip(self._encode(heads), plans):
            if missing:
                late = map(known.__getitem__, missing)
                parts = [p if p is not None else next(late) for p in parts]
            out.append(head + b"".join(parts))
        return out

    @functools.cached_property
    def _taken_apart(self):
        """Finds letters that are no longer one when the tokenizer has normalised them."""
        if self.tok.normalizer is None:
            return None
        letters = [c for c in map(chr, range(0x80, 0x110000)) if c.isalpha()]
        after = self.tok.normalizer.normalize_str(MARK.join(letters)).split(MARK)
        odd = [c for c, n in zip(letters, after, strict=True) if not n.isalpha()]
        return re.compile("[" + "".join(odd) + "]").search if odd else None

    def _letters(self, text: str) -> bool:
        return text.isalpha() and (text.isascii() or not self._taken_apart or not self._taken_apart(text))

    def _learn(self, chunks: set[str]) -> None:
        """Store the ids of ``" " + chunk``.

        Letters followed by punctuation split before the punctuation, so such a
        chunk is its word's ids and its tail's (if they are still letters when the
        tokenizer has normalised them: it takes some apart into a letter and a mark). Words share library calls: each
        is one piece of the split, whose first or last token shows in its name.
        Other chunks share calls with a mark between them that no chunk holds.
        """
        known, words, tailed, other, odd = self.spaced, set(), [], [], []
        for c in chunks:
            if c.isalpha():
                words.add(c)
                continue
            core = c.rstrip(PUNCTUATION)
            if self._letters(core):
                if core not in known:
                    words.add(core)
                tailed.append((c, core))
            elif not c or c[0].isspace() or c[-1].isspace() or " " in c or MARK in c:
                odd.append(c)
            else:
                other.append(c)
        known.update(zip(odd, self._encode([" " + c for c in odd])))
        self._learn_joined(list(words), " ", self._word_cuts)
        self._learn_joined(other, f" {MARK} ", self._mark_cuts)
        tails = self.tails
        fresh = list({c[len(core):] for c, core in tailed} - tails.keys())
        tails.update(zip(fresh, self._encode(fresh)))
        for c, core in tailed:
            known[c] = known[core] + tails[c[len(core):]]
        if len(tails) > self.max_chunks:
            tails.clear()

    def _learn_joined(self, chunks: list[str], between: str, cuts) -> None:
        groups = [chunks[i:i + GROUP] for i in range(0, len(chunks), GROUP)]
        texts = [" " + between.join([*g, ""]).rstrip(" ") for g in groups]
        for group, got in zip(groups, self.tok.encode_batch_fast(texts, add_special_tokens=False)):
            ids = np.array(got.ids, self.dtype)
            starts, ends = cuts(ids)
            if len(starts) != len(group):  # letters this library splits otherwise
                self.spaced.update(zip(group, self._encode([" " + c for c in group])))
                continue
            raw, w = ids.tobytes(), self.dtype.itemsize
            self.spaced.update(zip(group, [raw[a:b] for a, b in
                                           zip((starts * w).tolist(), (ends * w).tolist())]))

    def _mark_cuts(self, ids):
        marks = np.flatnonzero(ids == self.mark[-1])
        return np.concatenate(([0], marks + 1))[:-1], marks - len(self.mark) + 1

    def _word_cuts(self, ids):
        if self.ends is not None:
            stops = np.flatnonzero(self.ends[ids]) + 1
            return np.concatenate(([0], stops))[:-1], stops
        starts = np.flatnonzero(self.begins[ids])
        return starts, np.concatenate((starts, [len(ids)]))[1:]

    def ids(self, packed: bytes) -> np.ndarray:
        return np.frombuffer(packed, self.dtype)


def sized_batches(batches, id_name: str, text_name: str, max_chars: int = 4 << 20):
    """``(ids, texts)`` of about ``max_chars`` from Arrow batches; null text is empty."""
    ids, texts, n = [], [], 0
    for batch in batches:
        for i, t in zip(batch.column(id_name).to_pylist(), batch.column(text_name).to_pylist()):
            t = t or ""
            ids.append(i)
            texts.append(t)
            n += len(t)
            if n >= max_chars:
                yield ids, texts
                ids, texts, n = [], [], 0
    if ids:
        yield ids, texts
