"""Packing of documents into token sequences: first-fit decreasing with a tournament tree, in randomised groups.

Documents are tokenised once and cut at every ``length`` tokens.  Pieces are dealt into groups by a hash, about ``GROUP`` to a group, so no
source or group of copies decides what meets; each group is packed on its own: pieces by falling length, each into the first bin with
room, which a tournament tree of bin capacities finds in logarithmic time.
"""

from __future__ import annotations

import functools
import os
import re
import zlib
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from knownat.llm.store import written
from knownat.llm.text import slices

LENGTH = 2048
END = 1
END_BYTES = END.to_bytes(4, "little")
#: Pieces expected in a group.
GROUP = 4096
#: Chunks whose ids a Python worker remembers, over all its tasks: about 200 MB.
REMEMBERED = 1_000_000
_CHUNK = regex.compile(public_tokenizers.PATTERN)
_ASTRAL = re.compile("[\U00010000-\U0010ffff]")
_PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"


@functools.cache
def _plane_chunk() -> re.Pattern:
    """The pre-tokenizer's pattern for texts without characters above U+FFFF, its classes written out as ranges: ``re`` takes half the time of ``regex``."""
    plane = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x10000)]))

    def ranges(kind: str) -> str:
        codes = np.array([ord(c) for c in regex.findall(kind, plane)])
        ends = np.flatnonzero(np.diff(codes) != 1)
        return "".join(f"\\u{a:04x}-\\u{b:04x}" for a, b in zip(codes[np.append(0, ends + 1)], codes[np.append(ends, len(codes) - 1)]))

    pattern, kinds = public_tokenizers.PATTERN, {r"\p{L}": ranges(r"\p{L}"), r"\p{N}": ranges(r"\p{N}"), r"\s": ranges(r"\s")}
    pattern = regex.sub(r"\[[^\]]*\]", lambda m: functools.reduce(lambda text, k: text.replace(k, kinds[k]), kinds, m[0]), pattern)
    for kind, found in kinds.items():
        pattern = pattern.replace(kind, f"[{found}]")
    return re.compile(pattern.replace(r"\S", f"[^{kinds[r'\s']}]"))


def chunks_of(text: str) -> list[str]:
    """The chunks of the vocabulary's pre-tokenizer."""
    return (_CHUNK if _ASTRAL.search(text) else _plane_chunk()).findall(text)


class Tournament:
    """Free room of bins, open at first; every inner node holds the larger of its children."""

    def __init__(self, bins: int, room: int):
        self.leaves = 1 << max(0, (bins - 1).bit_length())
        self.tree = [room] * (2 * self.leaves)

    def take(self, size: int) -> tuple[int, int]:
        """Puts ``size`` into the first bin with room: the bin, and its room before."""
        tree, node = self.tree, 1
        while node < self.leaves:
            node *= 2
            node += tree[node] < size
        before, spot = tree[node], node - self.leaves
        tree[node] -= size
        while node > 1:
            node //= 2
            most = max(tree[2 * node], tree[2 * node + 1])
            if tree[node] == most:
                break
            tree[node] = most
        return spot, before


def first_fit_decreasing(sizes: np.ndarray, room: int) -> tuple[np.ndarray, np.ndarray]:
    """Bin and offset of every size; equal sizes go in the order given."""
    bins, offsets = np.zeros(len(sizes), np.int64), np.zeros(len(sizes), np.int64)
    tree = Tournament(max(1, len(sizes)), room)
    for i in np.argsort(-sizes, kind="stable"):
        spot, before = tree.take(int(sizes[i]))
        bins[i], offsets[i] = spot, room - before
    return bins, offsets


class Coder:
    """A vocabulary and the ids of chunks met lately.

    The vocabulary merges inside the chunks of its own pre-tokenizer only, so each different chunk is encoded once.  Chunks are remembered in
    two generations: when the younger is full it becomes the older, and what is not met again before the next time is forgotten.
    """

    def __init__(self, vocabulary: str, remembered: int = REMEMBERED):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.coder = Tokenizer.from_file(vocabulary)
        self.coder.encode_special_tokens = True  # their strings in a text are ordinary text
        self.most, self.young, self.old = remembered // 2, {}, {}

    def ids(self, texts: list[str | None]) -> Iterator[np.ndarray]:
        """Ids of each text and the end id."""
        cut = [chunks_of(t or "") for t in texts]
        if len(self.young) > self.most:
            self.young, self.old = {}, self.young
        wanted = set().union(*cut).difference(self.young)
        met = wanted.intersection(self.old)
        self.young.update((c, self.old[c]) for c in met)
        fresh = list(wanted - met)
        if fresh:
            # one encoding for all of them: its word numbers tell where each chunk's ids end
            encoded = self.coder.encode(fresh, is_pretokenized=True, add_special_tokens=False)
            data = np.array(encoded.ids, "<u4").tobytes()
            ends = np.cumsum(np.bincount(np.array(encoded.word_ids), minlength=len(fresh)) * 4).tolist()
            self.young.update(zip(fresh, (data[a:b] for a, b in zip([0, *ends], ends))))
        for chunks in cut:
            yield np.frombuffer(b"".join([*map(self.young.__getitem__, chunks), END_BYTES]), "<u4")


@functools.cache
def worker_coder(vocabulary: str) -> Coder:
    """The coder of this Python worker, which serves many tasks."""
    return Coder(vocabulary)


def _pieces(vocabulary: str, length: int, with_ids: bool):
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = worker_coder(vocabulary)
        names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", *(["ids"] if with_ids else [])]
        for batch in batches:
            for part in slices(batch, "text"):
                columns: list[list] = [[] for _ in names]
                for doc, ids in zip(part.column("doc_id").to_pylist(), coder.ids(part.column("text").to_pylist())):
                    for start in range(0, len(ids), length):
                        piece = ids[start : start + length]
                        row = (doc, start, len(piece), zlib.crc32(piece.tobytes()), len(ids), *((piece.astype(np.int64),) if with_ids else ()))
                        for column, value in zip(columns, row):
                            column.append(value)
                kinds = [pa.int64()] * 5 + [pa.list_(pa.int64())]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names)

    return cut


def _pack(length: int):
    def pack(table: pa.Table) -> pa.Table:
        order = np.lexsort((table["row"].to_numpy(), table["rank"].to_numpy()))
        table = table.take(pa.array(order))
        bins, offsets = first_fit_decreasing(table["length"].to_numpy(), length)
        group = table["group"].to_numpy().astype(np.int64)
        out = table.select(["doc_id", "start", "length", "ids_crc32", "doc_tokens"])
        return out.append_column("sequence_id", pa.array((group << 32) + bins)).append_column("offset", pa.array(offsets))

    return pack


def packed(docs: DataFrame, vocabulary: str, length: int = LENGTH, group: int = GROUP) -> DataFrame:
    """Where every piece of every document goes: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    Takes ``(doc_id, text)``, other columns are ignored.  A null or empty text is its end id alone; repeated rows are documents of their own;
    a text of any length is cut into pieces of ``length`` and a rest; an empty table gives an empty result.
    """
    pieces = docs.select("doc_id", "text").mapInArrow(_pieces(vocabulary, length, False), _PIECES)
    pieces = written(pieces.withColumn("row", F.monotonically_increasing_id()), "pieces")
    groups = max(1, -(-pieces.count() // group))
    rank = F.xxhash64("doc_id", "start", "row")
    dealt = pieces.withColumn("rank", rank).withColumn("group", F.pmod("rank", F.lit(groups)))
    return dealt.groupBy("group").applyInArrow(_pack(length), _PIECES + ", sequence_id long, offset long")


def sequences(docs: DataFrame, layout: DataFrame, vocabulary: str, length: int = LENGTH) -> DataFrame:
    """The padded ids of every sequence of a layout of documents with distinct ids: sequence_id, ids (0 fills up to ``length``, but at a power of two), n_tokens."""
    pieces = docs.select("doc_id", "text").mapInArrow(_pieces(vocabulary, length, True), _PIECES + ", ids array<long>")
    placed = pieces.select("doc_id", "start", "ids").join(layout.select("doc_id", "start", "sequence_id", "offset"), ["doc_id", "start"])
    whole = placed.groupBy("sequence_id").agg(F.array_sort(F.collect_list(F.struct("offset", "ids"))).alias("parts"))
    ids = F.flatten(F.transform("parts", lambda p: p["ids"]))
    n = F.size(ids)
    padded = F.when(n.bitwiseAND(n - 1) == 0, ids).otherwise(F.concat(ids, F.array_repeat(F.lit(0).cast("long"), length - n)))
    return whole.select("sequence_id", padded.alias("ids"), n.alias("n_tokens"))
