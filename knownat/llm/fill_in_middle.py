"""Fill-in-middle transformation by wavelet matrices over character classes.

Every byte of a text has a class: continuation of a code point, space, letter inside a word, first letter of a word, and the same at the start
of a line.  The classes of a slice of texts are stored as a wavelet matrix (one packed bit row per class bit, zeros sorted before ones), which
answers how often a class stands before any place in constant time.  A unit (code point, word or line) begins at some of the classes; the
sum of their ranks counts the units before a place, and bisection on that sum finds the byte where a given number of units ends.  Both cuts of
all texts of a slice are located together.

Rows are independent: nothing is shuffled, and memory is a small multiple of ``SLICE_BYTES`` or of one longer text.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from knownat.llm.text import slices, utf8

CONTINUATION, SPACE, INSIDE, WORD, LINE_SPACE, LINE_WORD = 0, 1, 2, 3, 5, 7
BITS = 3
#: Classes at which a unit of each kind begins.
UNITS = {"char": (SPACE, INSIDE, WORD, LINE_SPACE, LINE_WORD), "word": (WORD, LINE_WORD), "line": (LINE_SPACE, LINE_WORD)}
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
_MARKS = tuple(m.encode() for m in (PREFIX, SUFFIX, MIDDLE))
#: Of 100: texts that are left plain, and of the others those with the suffix first.
PLAIN, SUFFIX_FIRST = 10, 20
_SPACES = np.zeros(256, dtype=bool)
_SPACES[[0x20, *range(0x09, 0x0E)]] = True


def classes(raw: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Class of every byte of texts that lie end to end and begin at ``at``."""
    lead = (raw & 0xC0) != 0x80
    space = _SPACES[raw]
    head = np.zeros(len(raw), dtype=bool)
    head[at[:-1][at[:-1] < at[1:]]] = True
    line, word = head.copy(), head & ~space
    line[1:] |= raw[:-1] == 0x0A
    word[1:] |= space[:-1] & ~space[1:]
    out = np.where(space, SPACE, np.where(word, WORD, INSIDE)).astype(np.uint8)
    out[line] |= 4  # a line begins with a space or with a word
    out[~lead] = CONTINUATION
    return out


class WaveletMatrix:
    """Ranks of small symbols in a sequence."""

    def __init__(self, symbols: np.ndarray, bits: int = BITS):
        self.size, self.bits, self.rows = len(symbols), bits, []
        for level in reversed(range(bits)):
            bit = (symbols >> level) & 1
            packed = np.packbits(bit, bitorder="little")
            words = np.zeros(len(symbols) // 64 + 1, np.uint64)
            words.view(np.uint8)[: len(packed)] = packed
            before = np.zeros(len(words) + 1, np.int64)
            np.cumsum(np.bitwise_count(words), out=before[1:])
            self.rows.append((words, before, self.size - int(before[-1])))
            symbols = np.concatenate([symbols[bit == 0], symbols[bit == 1]])

    def rank(self, symbol: int, places: np.ndarray) -> np.ndarray:
        """How often ``symbol`` stands before each place."""
        low, high = np.zeros_like(places), places
        for level, (words, before, zeros) in zip(reversed(range(self.bits)), self.rows):
            ones = [self._ones(words, before, p) for p in (low, high)]
            low, high = [zeros + n if symbol >> level & 1 else p - n for n, p in zip(ones, (low, high))]
        return high - low

    @staticmethod
    def _ones(words: np.ndarray, before: np.ndarray, places: np.ndarray) -> np.ndarray:
        part = words[places >> 6] & ((np.uint64(1) << (places & 63).astype(np.uint64)) - np.uint64(1))
        return before[places >> 6] + np.bitwise_count(part)


class Units:
    """Numbers of units before places, and places of units, in texts that lie end to end."""

    def __init__(self, raw: np.ndarray, at: np.ndarray, kind: str):
        self.starts, self.at = UNITS[kind], at
        self.matrix = WaveletMatrix(classes(raw, at))
        self.first = self.before(at[:-1])
        self.count = self.before(at[1:]) - self.first

    def before(self, places: np.ndarray) -> np.ndarray:
        return sum(self.matrix.rank(c, places) for c in self.starts)

    def cut(self, n: np.ndarray) -> np.ndarray:
        """Byte where the first ``n[d]`` units of text d end: the start of the next one, by bisection on ranks."""
        low, high = self.at[:-1].copy(), self.at[1:].copy()
        while (open_ := low < high).any():
            middle = (low + high) // 2
            reached = self.before(middle + 1) - self.first > n
            high = np.where(open_ & reached, middle, high)
            low = np.where(open_ & ~reached, middle + 1, low)
        return np.where(n == 0, self.at[:-1], low)


def draws(doc_id: int | None, seed: int) -> tuple[int, ...]:
    """Four unsigned 32-bit numbers from the id; a null id counts as an empty one."""
    text = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    return tuple(int(text[k : k + 8], 16) for k in range(0, 32, 8))


def _transform(kind: str, seed: int):
    names = ["doc_id", "n", "form", "prefix_units", "middle_units", "output"]
    kinds = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                raw, at = utf8(part.column("text"))
                units = Units(raw, at, kind)
                ids, n = part.column("doc_id").to_pylist(), units.count
                h = np.array([draws(i, seed) for i in ids], np.int64)
                ends = np.sort(h[:, :2] % (n + 1)[:, None], axis=1)
                cuts = np.stack([at[:-1], units.cut(ends[:, 0]), units.cut(ends[:, 1]), at[1:]], axis=1)
                data, rows = raw.tobytes(), []
                for k, doc in enumerate(ids):
                    a, b, c, d = cuts[k].tolist()
                    text = data[a:d]
                    if not text or h[k, 2] % 100 >= 100 - PLAIN or any(m in text for m in _MARKS):
                        rows.append((doc, int(n[k]), "plain", None, None, text))
                        continue
                    p, s, m = _MARKS
                    before, middle, after = data[a:b], data[b:c], data[c:d]
                    suffix_first = h[k, 3] % 100 < SUFFIX_FIRST
                    out = s + after + p + before + m + middle if suffix_first else p + before + s + after + m + middle
                    rows.append((doc, int(n[k]), "spm" if suffix_first else "psm", int(ends[k, 0]), int(ends[k, 1] - ends[k, 0]), out))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names)

    return run


def fill_in_middle(docs: DataFrame, unit: str = "char", seed: int = 1) -> DataFrame:
    """``(doc_id, text)`` to (doc_id, n, form, prefix_units, middle_units, output), one row per input row; other columns are ignored.

    ``n`` is the number of units (``char``, ``word`` or ``line``); the prefix ends after the smaller, the middle after the larger of two
    numbers of units drawn from the id, so repeated rows are cut alike.  ``form`` is ``psm``, ``spm`` or ``plain``: texts that are empty, null
    (as empty) or hold one of the marks stay plain, as do ``PLAIN`` of 100 others, and their unit counts are null.  What stands before the
    first word or line belongs to the first unit.  A null id draws like an empty one; a text of any length is cut as a whole; an empty table
    gives an empty result.
    """
    kind = "doc_id long, n long, form string, prefix_units long, middle_units long, output string"
    return docs.select("doc_id", "text").mapInArrow(_transform(unit, seed), kind)


def restored(output: Column, form: Column) -> Column:
    """The text an output was made of.  No text holds a mark, and none can arise where text and mark meet, so the first ones are the marks."""
    def parts(second: str) -> tuple[Column, Column, Column]:
        one = F.call_function("locate", F.lit(second), output, F.lit(4))
        two = F.call_function("locate", F.lit(MIDDLE), output, one + 3)
        return output.substr(F.lit(4), one - 4), output.substr(one + 3, two - one - 3), output.substr(two + 3, F.length(output))

    before, after, middle = parts(SUFFIX)
    after2, before2, middle2 = parts(PREFIX)
    return F.when(form == "psm", F.concat(before, middle, after)).when(form == "spm", F.concat(before2, middle2, after2)).otherwise(output)
