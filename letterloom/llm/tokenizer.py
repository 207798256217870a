"""Byte-level BPE with the vocabulary file of a public tokenizer.

Texts are cut into words (pre-tokens) by code-point class for a whole Arrow batch at once. A word's ids are found once
per worker by merging over a doubly linked list of symbols with a priority queue of ranks, skipping stale entries, and
kept; a batch is then put together from the kept ids by array arithmetic. Decoding concatenates vocabulary strings.

Defined results: null and empty texts give an empty list of ids; the strings of special tokens are ordinary text.
"""

from __future__ import annotations

import base64
import heapq
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: The folder of the vocabulary files; a parameter of every function that needs it.
TOKENIZERS = "/opt/tokenizers"
#: Words whose ids a worker keeps; beyond it the store starts anew, with the same results.
KEPT_WORDS = 2_000_000

_LETTER, _NUMBER, _SPACE, _OTHER, _UNSEEN = 0, 1, 2, 3, 255
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
# Contractions that are words of their own.
CONTRACTIONS = ("s", "t", "m", "d", "re", "ve", "ll")


@lru_cache(maxsize=8)
def ranks(path: str) -> dict[bytes, int]:
    """Symbol bytes to id, from a file with a base64 symbol and its rank in each line."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


def merge_word(word: bytes, rank: dict[bytes, int]) -> list[int]:
    """Ids of one word: the adjacent pair of least rank, leftmost first, is merged until none has a rank."""
    if word in rank:
        return [rank[word]]
    n = len(word)
    start, end = list(range(n)), list(range(1, n + 1))
    left, right = list(range(-1, n - 1)), [*range(1, n), -1]
    alive = [True] * n
    queue: list[tuple[int, int, int]] = []
    for i in range(n - 1):
        if (r := rank.get(word[i : i + 2])) is not None:
            queue.append((r, i, i + 2))
    heapq.heapify(queue)
    while queue:
        _, i, stop = heapq.heappop(queue)
        j = right[i] if alive[i] else -1
        if j < 0 or end[j] != stop:  # stale: one of the two has been merged since
            continue
        end[i], right[i], alive[j] = end[j], right[j], False
        if right[j] >= 0:
            left[right[j]] = i
        for a in (left[i], i):
            if a >= 0 and (b := right[a]) >= 0 and (r := rank.get(word[start[a] : end[b]])) is not None:
                heapq.heappush(queue, (r, a, end[b]))
    out, i = [], 0
    while i >= 0:
        out.append(rank[word[start[i] : end[i]]])
        i = right[i]
    return out


class Encoder:
    """Encoder of one vocabulary file. One per worker and path, see ``encoder``."""

    def __init__(self, path: str):
        self.rank = ranks(path)
        self.symbols = {i: s for s, i in self.rank.items()}
        self.classes = np.full(0x110000, _UNSEEN, dtype=np.uint8)
        self._forget()

    def _forget(self) -> None:
        self.keys = np.empty(0, dtype=np.uint64)  # sorted word digests
        self.slot = np.empty(0, dtype=np.int64)  # their places in starts/lengths
        self.starts, self.lengths = np.empty(0, dtype=np.int64), np.empty(0, dtype=np.int64)
        self.pool = np.empty(0, dtype=np.int32)
        self.letters = np.empty(0, dtype=np.uint32)  # the words themselves, with their places and sizes
        self.letter, self.sizes = np.empty(0, dtype=np.int64), np.empty(0, dtype=np.int64)

    def _class(self, codes: np.ndarray) -> np.ndarray:
        found = self.classes[codes]
        if (found == _UNSEEN).any():
            for c in np.unique(codes[found == _UNSEEN]).tolist():
                kind = unicodedata.category(chr(c))[0]
                self.classes[c] = _SPACE if chr(c).isspace() and c not in (0x1C, 0x1D, 0x1E, 0x1F) else _LETTER if kind == "L" else _NUMBER if kind == "N" else _OTHER
            found = self.classes[codes]
        return found

    def cuts(self, codes: np.ndarray, first: np.ndarray) -> np.ndarray:
        """True where a word begins. ``first`` marks the first character of each text."""
        n = len(codes)
        kind = self._class(codes)
        new = np.ones(n, dtype=bool)
        new[1:] = kind[1:] != kind[:-1]
        new |= first
        # The last white space before other characters stands alone; a blank leads the word after it.
        space = kind == _SPACE
        last = np.zeros(n, dtype=bool)
        last[:-1] = space[:-1] & ~space[1:] & ~first[1:]
        begin = new | last
        lead = last & (codes == 32)
        after = np.zeros(n, dtype=bool)
        after[1:] = lead[:-1]
        begin &= ~after
        # Contractions: an apostrophe that begins a word takes its letters along, and the letters after them are a new word.
        for p in np.flatnonzero((codes == 39) & begin).tolist():
            tail = codes[p + 1 : p + 3].tolist()
            size = next((len(c) for c in CONTRACTIONS if tail[: len(c)] == [ord(x) for x in c] and not first[p + 1 : p + 1 + len(c)].any()), 0)
            if size:
                begin[p + 1] = False
                q = p + 1 + size
                if q < n:
                    begin[q] = True
                    if lead[q]:
                        begin[q + 1] = False
        return begin

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts in a row, offsets of each text in them)."""
        sizes = np.array([len(t) if t else 0 for t in texts], dtype=np.int64)
        whole = "".join(t for t in texts if t)
        if not whole:
            return np.empty(0, dtype=np.int32), np.zeros(len(texts) + 1, dtype=np.int64)
        codes = np.frombuffer(whole.encode("utf-32-le"), dtype=np.uint32)
        n = len(codes)
        at = np.concatenate([[0], np.cumsum(sizes)])
        first = np.zeros(n + 1, dtype=bool)
        first[at] = True
        begin = np.flatnonzero(self.cuts(codes, first[:n]))
        stop = np.append(begin[1:], n)
        # Digest of each word: a polynomial in its code points, the same wherever it stands. Equal digests are compared.
        up, down = self._powers(n)
        with np.errstate(over="ignore"):
            sums = np.concatenate([np.zeros(1, dtype=np.uint64), np.cumsum((codes.astype(np.uint64) + np.uint64(1)) * up[:n], dtype=np.uint64)])
            digest = (sums[stop] - sums[begin]) * down[begin]
            digest ^= digest >> np.uint64(29)
            digest *= np.uint64(0xBF58476D1CE4E5B9)
            digest ^= digest >> np.uint64(32)
        words, where, back = np.unique(digest, return_index=True, return_inverse=True)
        place = None
        if _equal(codes, begin, stop - begin, codes, begin[where][back], (stop - begin)[where][back]):
            place = self._places(words, codes, (whole, begin[where], stop[where]))
        if place is None:  # two words of one digest: by the words themselves
            own = {w: merge_word(w.encode(), self.rank) for w in {whole[a:b] for a, b in zip(begin.tolist(), stop.tolist(), strict=True)}}
            each = [own[whole[a:b]] for a, b in zip(begin.tolist(), stop.tolist(), strict=True)]
            ends, ids = np.cumsum([len(x) for x in each]), np.array([i for x in each for i in x], dtype=np.int32)
        else:
            counts = self.lengths[place][back]
            from_ = self.starts[place][back]
            ends = np.cumsum(counts)
            ids = self.pool[np.repeat(from_ - (ends - counts), counts) + np.arange(ends[-1])]
        upto = np.concatenate([[0], ends])[np.searchsorted(begin, at)]
        return ids, upto

    def _powers(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(getattr(self, "_up", ())) < n:
            with np.errstate(over="ignore"):
                size = 1 << n.bit_length()
                self._up = np.cumprod(np.concatenate([[np.uint64(1)], np.full(size - 1, _BASE, dtype=np.uint64)]), dtype=np.uint64)
                self._down = np.cumprod(np.concatenate([[np.uint64(1)], np.full(size - 1, _INVERSE, dtype=np.uint64)]), dtype=np.uint64)
        return self._up, self._down

    def _places(self, words: np.ndarray, codes: np.ndarray, source: tuple[str, np.ndarray, np.ndarray]) -> np.ndarray | None:
        """Places of the words' ids; new words are merged and kept. None where a kept word of a digest is another word."""
        if len(self.keys) + len(words) > KEPT_WORDS:
            self._forget()
        at = np.searchsorted(self.keys, words)
        known = at < len(self.keys)
        known[known] = self.keys[at[known]] == words[known]
        new = np.flatnonzero(~known)
        whole, begin, stop = source
        old = np.flatnonzero(known)
        slot = self.slot[at[old]]
        if not _equal(codes, begin[old], (stop - begin)[old], self.letters, self.letter[slot], self.sizes[slot]):
            return None
        if len(new):
            rank = self.rank
            fresh = [merge_word(whole[a:b].encode(), rank) for a, b in zip(begin[new].tolist(), stop[new].tolist(), strict=True)]
            lengths = np.array([len(x) for x in fresh], dtype=np.int64)
            starts = len(self.pool) + np.concatenate([[0], np.cumsum(lengths)[:-1]])
            self.pool = np.concatenate([self.pool, np.array([i for x in fresh for i in x], dtype=np.int32)])
            slots = len(self.starts) + np.arange(len(new))
            sizes = (stop - begin)[new]
            self.letter = np.concatenate([self.letter, len(self.letters) + np.concatenate([[0], np.cumsum(sizes)[:-1]])])
            self.sizes = np.concatenate([self.sizes, sizes])
            self.letters = np.concatenate([self.letters, codes[_spread(begin[new], sizes)]])
            self.starts, self.lengths = np.concatenate([self.starts, starts]), np.concatenate([self.lengths, lengths])
            keys, slot = np.concatenate([self.keys, words[new]]), np.concatenate([self.slot, slots])
            order = np.argsort(keys, kind="stable")
            self.keys, self.slot = keys[order], slot[order]
            at = np.searchsorted(self.keys, words)
        return self.slot[at]

    def decode(self, ids: list[int]) -> str:
        """The text of ids; bytes that are no character become U+FFFD, as at a cut within a character."""
        return b"".join(self.symbols[i] for i in ids).decode("utf-8", errors="replace")


def _spread(begin: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Places of all characters of words."""
    ends = np.cumsum(sizes)
    return np.repeat(begin - (ends - sizes), sizes) + np.arange(int(ends[-1]) if len(ends) else 0)


def _equal(a: np.ndarray, at: np.ndarray, sizes: np.ndarray, b: np.ndarray, there: np.ndarray, others: np.ndarray) -> bool:
    """Whether words (place and size) of two arrays of characters are equal, each to its own."""
    return bool(np.array_equal(sizes, others) and np.array_equal(a[_spread(at, sizes)], b[_spread(there, sizes)]))


@lru_cache(maxsize=4)
def encoder(path: str) -> Encoder:
    return Encoder(path)


#: Characters that are put together at once; bounds the memory of a worker whatever the batch holds.
CHUNK = 2_000_000


def _chunks(texts: list[str | None]) -> Iterator[list[str | None]]:
    chunk, size = [], 0
    for t in texts:
        chunk.append(t)
        size += len(t) if t else 0
        if size >= CHUNK:
            yield chunk
            chunk, size = [], 0
    if chunk:
        yield chunk


def encode_column(df: DataFrame, text: str, ids: str = "ids", name: str = "byte_bpe_50k", folder: str = TOKENIZERS, counts_only: bool = False, sizes: str = "n_tokens") -> DataFrame:
    """``df`` without ``text`` and with its ids (or, with ``counts_only``, their number). No shuffle; Arrow in and out."""
    path = f"{folder}/{name}.tiktoken"
    other = [c for c in df.columns if c != text]
    kept = df.select(*other, text).schema
    from pyspark.sql import types as T

    out_type = T.StructField(sizes, T.IntegerType()) if counts_only else T.StructField(ids, T.ArrayType(T.IntegerType(), False), False)
    schema = T.StructType([f for f in kept.fields if f.name != text] + [out_type])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        for batch in batches:
            texts = batch.column(len(other)).to_pylist()
            done = 0
            for chunk in _chunks(texts):
                flat, at = enc.encode(chunk)
                own = [batch.column(i).slice(done, len(chunk)) for i in range(len(other))]
                done += len(chunk)
                last = pa.array(np.diff(at).astype(np.int32)) if counts_only else pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(flat))
                yield pa.RecordBatch.from_arrays([*own, last], names=[*other, sizes if counts_only else ids])

    return df.select(*other, F.col(text)).mapInArrow(run, schema)
