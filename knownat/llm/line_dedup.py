"""Removal of runs of lines that stand earlier in the corpus, by winnowing over line hashes.

A window is the shortest run of lines from a line on, or up to a line, that holds ``WORDS`` words; its line with the smallest hash is its
fingerprint, so two places that share a run of so many words are sure to share a fingerprint.  Postings of equal fingerprints are joined, and
windows compared whole.  Windows from the left and from the right together reach every line of a shared run: the match is extended
both ways.  The first place, by doc_id and position, keeps its lines; all later ones lose them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from knownat.llm.store import written
from knownat.llm.text import mix, signed, slices

#: Words a repeated run must hold to be removed.
WORDS = 50
_POSTINGS = "doc_id long, ref long, print long, window long, first int, last int"


def winnowed(lines: list[str], n_words: int) -> Iterator[tuple[int, int, int, int]]:
    """Windows of one text: fingerprint, hash, first and last line.  Blank lines belong to the run around them and count no words."""
    solid = [(i, line) for i, line in enumerate(lines) if line]
    if not solid:
        return
    counts = np.array([len(line.split()) for _, line in solid])
    hashes = np.array([xxhash.xxh3_64_intdigest(line.encode("utf-8", "surrogatepass")) for _, line in solid], np.uint64)
    total = np.concatenate([[0], np.cumsum(counts)])
    if total[-1] < n_words:
        return
    at = np.arange(len(solid))
    ends = np.searchsorted(total, total[:-1] + n_words)  # the window from a line on ends before this line
    begins = np.searchsorted(total, total[1:] - n_words, side="right") - 1  # the window up to a line begins here
    right, left = ends <= len(solid), total[1:] >= n_words
    found = np.unique(np.concatenate([np.stack([at[right], ends[right]], 1), np.stack([begins[left], at[left] + 1], 1)]), axis=0)
    for a, b in found.tolist():
        part = hashes[a:b]
        yield int(part.min()), xxhash.xxh3_64_intdigest(mix(part).tobytes()), solid[a][0], solid[b - 1][0]


def _split(text: str | None) -> list[str]:
    return [line.strip() for line in (text or "").split("\n")]


def _post(n_words: int):
    def post(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                rows: list[tuple] = []
                for doc, ref, text in zip(*(part.column(k).to_pylist() for k in ("doc_id", "ref", "text"))):
                    rows += ((doc, ref, *w) for w in winnowed(_split(text), n_words))
                doc, ref, mark, window, first, last = zip(*rows) if rows else ((),) * 6
                longs = [signed(np.array(v, np.uint64)) for v in (mark, window)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(doc, pa.int64()), pa.array(ref, pa.int64()), *map(pa.array, longs), pa.array(first, pa.int32()), pa.array(last, pa.int32())],
                    ["doc_id", "ref", "print", "window", "first", "last"],
                )

    return post


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in slices(batch, "text"):
            texts, totals, removed = [], [], []
            for text, ranges in zip(part.column("text").to_pylist(), part.column("ranges").to_pylist()):
                lines = (text or "").split("\n")
                gone = {i for r in ranges or () for i in range(r["first"], r["last"] + 1)}
                texts.append(text if not gone else "\n".join(line for i, line in enumerate(lines) if i not in gone))
                totals.append(len(lines) if text else 0)
                removed.append(sorted(gone))
            yield pa.RecordBatch.from_arrays(
                [part.column("row"), pa.array(texts, pa.string()), pa.array(totals, pa.int64()), pa.array(removed, pa.list_(pa.int32()))],
                ["row", "kept", "n_lines", "removed"],
            )


def line_dedup(docs: DataFrame, n_words: int = WORDS) -> DataFrame:
    """Each row of ``docs`` as ``row`` (all columns), with kept (the text without repeated runs), n_lines and removed (numbers of lines).

    Lines are compared without the blanks around them.  Null texts stay null; texts under ``n_words`` words are never changed; rows with equal
    doc_id and text are one document and treated alike; a null doc_id comes before all others; a text that loses all lines becomes empty
    and its row stays; an empty table gives an empty result.
    """
    keyed = docs.select(F.struct(*docs.columns).alias("row"), "doc_id", "text").withColumn("ref", F.xxhash64("doc_id", "text"))
    postings = written(keyed.select("doc_id", "ref", "text").mapInArrow(_post(n_words), _POSTINGS).distinct(), "line_postings")
    place = F.struct("doc_id", "ref", "first")
    shared = postings.groupBy("print", "window").agg(F.min(place).alias("earliest"), F.max(place).alias("latest")).where("earliest <> latest").drop("latest")
    later = postings.join(shared, ["print", "window"]).where(~place.eqNullSafe(F.col("earliest")))
    ranges = later.groupBy(F.col("doc_id").alias("id"), F.col("ref").alias("of")).agg(F.collect_set(F.struct("first", "last")).alias("ranges"))
    rows = keyed.join(ranges, keyed["doc_id"].eqNullSafe(F.col("id")) & (keyed["ref"] == F.col("of")), "left").select("row", "text", "ranges")
    kind = rows.schema["row"].dataType.simpleString()
    return rows.mapInArrow(_cut, f"row {kind}, kept string, n_lines long, removed array<int>")


def without_repeated_lines(docs: DataFrame, n_words: int = WORDS) -> DataFrame:
    """The documents with later repeated runs of lines cut from their texts, all columns kept, every row kept."""
    cut = line_dedup(docs, n_words)
    return cut.select(*(F.col("kept").alias(c) if c == "text" else F.col("row")[c].alias(c) for c in docs.columns))
