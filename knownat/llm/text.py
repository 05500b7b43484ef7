"""Whole Arrow batches of texts as numpy arrays: words, spans and their 64-bit hashes, without a loop per document."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text worked on at a time; a longer text is a slice of its own.
SLICE_BYTES = 2 << 20

_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
#: White space of the word pattern ``[^\x20\x09-\x0D]+``.
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True

_powers = {"up": np.ones(1, np.uint64), "down": np.ones(1, np.uint64)}


def _tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2**64, at least ``n`` of each."""
    if len(_powers["up"]) < n:
        size = 1 << max(16, (n - 1).bit_length())
        for name, base in (("up", _BASE), ("down", _INVERSE)):
            table = np.full(size, base, np.uint64)
            table[0] = 1
            _powers[name] = np.cumprod(table, dtype=np.uint64)
    return _powers["up"], _powers["down"]


def mix(x: np.ndarray) -> np.ndarray:
    """Finalizer that spreads every input bit over the 64 output bits."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def slices(batch: pa.RecordBatch, column: str, most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cuts a batch so that each part holds about ``most`` bytes of text, or one longer text."""
    if not batch.num_rows:
        return
    values = batch.column(column)
    sizes = pc.fill_null(pc.binary_length(values), 0).to_numpy(zero_copy_only=False)
    block = np.cumsum(sizes, dtype=np.int64) // most
    cuts = [0, *(np.flatnonzero(np.diff(block)) + 1).tolist(), batch.num_rows]
    for lo, hi in zip(cuts, cuts[1:]):
        if hi > lo:
            yield batch.slice(lo, hi - lo)


def utf8(values: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of all texts end to end, and the n + 1 places where they begin and end; null counts as empty."""
    values = pc.fill_null(values, "")
    wide = pa.types.is_large_string(values.type)
    _, places, data = values.buffers()
    at = np.frombuffer(places, np.int64 if wide else np.int32)[values.offset : values.offset + len(values) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None else np.zeros(0, np.uint8)
    return raw, at - at[0]


class SpanHash:
    """Hashes of any byte spans of one buffer, each in constant time."""

    def __init__(self, raw: np.ndarray):
        up, self.down = _tables(len(raw) + 1)
        self.sums = np.zeros(len(raw) + 1, np.uint64)
        np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * up[: len(raw)], out=self.sums[1:])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        value = (self.sums[end] - self.sums[start]) * self.down[start]
        return mix(value + (end - start).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


@dataclass
class Words:
    """Words of a slice: ``hash``, ``start`` and ``end`` in bytes; document d has words ``first[d]`` to ``first[d + 1]``."""

    hash: np.ndarray
    start: np.ndarray
    end: np.ndarray
    first: np.ndarray


def bounds(raw: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Where the words ``[^\\x20\\x09-\\x0D]+`` of every text begin and end, and which is the first of each text."""
    letter = ~_SPACE[raw]
    begin, stop = letter.copy(), letter.copy()
    if len(raw):
        inner = at[1:-1]
        inner = inner[(inner > 0) & (inner < len(raw))]
        glued = letter[:-1] & letter[1:]
        glued[inner - 1] = False
        begin[1:] &= ~glued
        stop[:-1] &= ~glued
    start, end = np.flatnonzero(begin), np.flatnonzero(stop) + 1
    return start, end, np.searchsorted(start, at)


def words(raw: np.ndarray, at: np.ndarray) -> Words:
    """Words of every text, A-Z lower-cased before hashing."""
    start, end, first = bounds(raw, at)
    return Words(SpanHash(_LOWER[raw]).of(start, end), start, end, first)


#: By their length, the bits of a short word's bytes in the eight from its beginning.
_BYTES = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)
#: Bytes of the longest word that is hashed eight bytes at a time; each eight are a pass over all words so long.
_SHORT = 64


def word_hashes(raw: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hashes of words, A-Z lower-cased: others than those of ``words``, at a cost by the word and not by the byte."""
    low = np.zeros(len(raw) + 8, np.uint8)
    np.take(_LOWER, raw, out=low[: len(raw)])
    eight = np.ndarray(len(raw) + 1, "<u8", low, strides=(1,))
    size = end - start
    out = size.astype(np.uint64)
    long_ = size > _SHORT
    left = np.flatnonzero(~long_) if long_.any() else None
    for at in range(0, _SHORT, 8):
        rest = (size if left is None else size[left]) - at
        if at:
            on = np.flatnonzero(rest > 0)
            left, rest = on if left is None else left[on], rest[on]
            if not len(left):
                break
        some = slice(None) if left is None else left
        out[some] = mix(out[some] * np.uint64(_BASE) + (eight[start[some] + at] & _BYTES[np.minimum(rest, 8)]))
    if long_.any():
        size = size[long_]
        ends = np.cumsum(size)
        places = np.arange(ends[-1]) + np.repeat(start[long_] - ends + size, size)
        out[long_] = SpanHash(low[places]).of(ends - size, ends)
    return out


def runs(values: np.ndarray, first: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of ``width`` consecutive values that lie in one document.

    A document with fewer values, but some, gives its whole sequence as one.  Returns the hashes and, like ``first``, where each document's begin.
    """
    count = np.diff(first)
    kept = np.where(count == 0, 0, np.maximum(count - width + 1, 1))
    begins = np.zeros(len(kept) + 1, np.int64)
    np.cumsum(kept, out=begins[1:])
    doc = np.repeat(np.arange(len(kept)), kept)
    at = np.arange(begins[-1]) - begins[doc] + first[doc]
    left = np.minimum(count[doc], width)
    out = left.astype(np.uint64) * np.uint64(0xA0761D6478BD642F)
    padded = np.concatenate([values, np.zeros(width, np.uint64)])
    for k in range(width):
        out = mix(out + np.where(k < left, padded[at + k], np.uint64(0)))
    return out, begins


def signed(x: np.ndarray) -> np.ndarray:
    """The same 64 bits as Spark's long."""
    return x.view(np.int64)
