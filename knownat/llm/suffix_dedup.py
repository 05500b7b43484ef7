"""Removal of long byte strings that occur more than once, found with suffix orders built column by column.

The collection-wide construction inserts one symbol of every document per round.  Over whole texts that takes as many rounds over all
bytes as the longest text has bytes, so texts are first cut, without losing a match, into short strings that share an alignment:

* every window of ``length`` bytes has a minimizer, its leftmost ``SEED``-byte seed with the smallest hash, which depends on the window's
  bytes only; equal windows have it at the same place.  All window starts with one minimizer form one *span* of text around it.
* spans with the same seed and the same bytes are one class, counted in Spark; if it has two members, all its windows repeat.
* only spans that share a seed but differ are compared.  They are aligned at the seed, so a round inserts one column, from right to
  left: the order of all suffixes of that column and their common prefixes with the neighbour follow from those of the column before by a
  stable sort on the new symbol and range minima.  A window repeats if it shares ``length`` bytes with a neighbour.  At most
  2 * length - SEED rounds are needed, over batches of whole seeds that Spark sorts and spills to its own sequential files.

A seed with more than ``batch`` different spans is not taken into one task: its windows are hashed and counted in Spark.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from knownat.llm.store import written
from knownat.llm.text import SpanHash, mix, signed, slices, utf8

SEED = 128
#: Strings whose columns are sorted together.
BATCH = 8192
#: Bits of the filter on wanted spans; false positives cost time, not results.
FILTER_BITS = 1 << 24
SPANS = "doc_id long, ref long, seed long, span long, span2 long, lo int, hi int, off int"


def spans_of(raw: np.ndarray, at: np.ndarray, length: int, seed: int) -> dict[str, np.ndarray]:
    """Spans of all texts of a slice: document, first and last window start, minimizer place and hash, and a hash of the bytes."""
    n = len(raw)
    none = {k: np.zeros(0, np.int64) for k in ("doc", "lo", "hi", "place")} | {k: np.zeros(0, np.uint64) for k in ("seed", "span")}
    if n < length:
        return none
    hashed = SpanHash(raw)
    starts = np.arange(n - seed + 1)
    hashes = hashed.of(starts, starts + seed)
    wide = length - seed + 1
    ranked = (hashes >> np.uint64(32) << np.uint64(32)) | starts.astype(np.uint64)
    blocks = -(-len(ranked) // wide)
    padded = np.full(blocks * wide, np.iinfo(np.uint64).max, np.uint64)
    padded[: len(ranked)] = ranked
    padded = padded.reshape(blocks, wide)
    ahead = np.minimum.accumulate(padded, axis=1).ravel()
    back = np.minimum.accumulate(padded[:, ::-1], axis=1)[:, ::-1].ravel()
    windows = n - length + 1
    place = (np.minimum(back[:windows], ahead[wide - 1 : wide - 1 + windows]) & np.uint64(0xFFFFFFFF)).astype(np.int64)
    sizes = np.maximum(np.diff(at) - length + 1, 0)
    total = int(sizes.sum())
    if not total:
        return none
    doc = np.repeat(np.arange(len(sizes)), sizes)
    start = np.arange(total) - np.repeat(np.cumsum(sizes) - sizes, sizes) + at[:-1][doc]
    place = place[start]
    fresh = np.flatnonzero(np.concatenate([[True], (place[1:] != place[:-1]) | (doc[1:] != doc[:-1])]))
    last = np.concatenate([fresh[1:], [total]]) - 1
    lo, hi = start[fresh], start[last]
    return {"doc": doc[fresh], "lo": lo, "hi": hi, "place": place[fresh], "seed": hashes[place[fresh]], "span": hashed.of(lo, hi + length)}


def _emit(length: int, seed: int, wanted=None):
    """Rows of ``SPANS``; with ``wanted`` only spans that pass the filter, and their bytes."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.frombuffer(wanted.value, np.uint8) if wanted is not None else None
        for batch in batches:
            for part in slices(batch, "text"):
                raw, at = utf8(part.column("text"))
                s = spans_of(raw, at, length, seed)
                ref = part.column("ref").to_numpy()
                if bits is not None:
                    spot = spot_of(ref[s["doc"]], s["lo"] - at[s["doc"]])
                    hit = (bits[spot >> 3] >> (spot & 7).astype(np.uint8)) & 1 == 1
                    s = {k: v[hit] for k, v in s.items()}
                data = raw.tobytes()
                begins, ends = s["lo"].tolist(), (s["hi"] + length).tolist()
                second = np.fromiter((xxhash.xxh3_64_intdigest(data[b:e]) for b, e in zip(begins, ends)), np.uint64, len(begins))
                base = at[s["doc"]]
                columns = [
                    part.column("doc_id").take(pa.array(s["doc"])), pa.array(ref[s["doc"]]), pa.array(signed(s["seed"])), pa.array(signed(s["span"])),
                    pa.array(signed(second)), pa.array((s["lo"] - base).astype(np.int32)), pa.array((s["hi"] - base).astype(np.int32)),
                    pa.array((s["place"] - s["lo"]).astype(np.int32)),
                ]
                names = ["doc_id", "ref", "seed", "span", "span2", "lo", "hi", "off"]
                if bits is not None:
                    columns.append(pa.array([data[b:e] for b, e in zip(begins, ends)], pa.binary()))
                    names.append("bytes")
                yield pa.RecordBatch.from_arrays(columns, names)

    return emit


def spot_of(ref: np.ndarray, lo: np.ndarray) -> np.ndarray:
    """Place of a span in the filter."""
    return (mix(ref.view(np.uint64) + mix(lo.astype(np.uint64))) & np.uint64(FILTER_BITS - 1)).astype(np.int64)


def _bytes_of_filter(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        spot = np.unique(spot_of(batch.column("ref").to_numpy(), batch.column("lo").to_numpy().astype(np.int64)))
        byte, first = np.unique(spot >> 3, return_index=True)
        bits = np.bitwise_or.reduceat(1 << (spot & 7), first) if len(spot) else spot
        yield pa.RecordBatch.from_arrays([pa.array(byte.astype(np.int32)), pa.array(bits.astype(np.int32))], ["byte", "bits"])


def column_repeats(strings: list[bytes], off: np.ndarray, group: np.ndarray, length: int) -> list[np.ndarray]:
    """For each string, which of its windows also stand, equally aligned, in another string of its group.

    ``off`` is the place of the shared seed in each string; ``group`` is sorted.  One round per column, from right to left.
    """
    m = len(strings)
    sizes = np.array([len(s) for s in strings])
    left = int(off.max())
    width = left + int((sizes - off).max())
    cells = np.zeros((m, width), np.uint16)  # 0: the string has no byte in this column
    shift = left - off
    rows = np.repeat(np.arange(m), sizes)
    cells[rows, np.arange(len(rows)) - np.repeat(np.cumsum(sizes) - sizes, sizes) + np.repeat(shift, sizes)] = np.frombuffer(b"".join(strings), np.uint8).astype(np.uint16) + 1
    columns = np.ascontiguousarray(cells.T)
    order, shared = np.arange(m), np.zeros(m + 1, np.int64)
    repeated = np.zeros((width, m), bool)
    scaled = group.astype(np.int64) * 512
    for c in range(width - 1, -1, -1):
        key = scaled[order] + columns[c][order]
        if (key[1:] >= key[:-1]).all():
            rank = np.arange(m)
        else:
            rank = np.argsort(key, kind="stable")
            order, key = order[rank], key[rank]
        tied = np.flatnonzero((key[1:] == key[:-1]) & (key[1:] & 511 > 0)) + 1
        fresh = np.zeros(m + 1, np.int64)
        if len(tied):
            ends = np.empty(2 * len(tied), np.int64)
            ends[::2], ends[1::2] = rank[tied - 1] + 1, rank[tied] + 1
            fresh[tied] = 1 + np.minimum.reduceat(shared, ends)[::2]
        shared = fresh
        repeated[c, order] = np.maximum(shared[:-1], shared[1:]) >= length
    repeated = repeated.T
    return [repeated[i, shift[i] : shift[i] + sizes[i] - length + 1] for i in range(m)]


def true_runs(flags: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last index of each run of true values."""
    edge = np.diff(np.concatenate([[0], flags.astype(np.int8), [0]]))
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1) - 1


def _compare(length: int, batch_size: int):
    """Over rows sorted by seed: repeated windows as ranges of starts within each span."""

    def flush(held: list[tuple]) -> pa.RecordBatch:
        seeds = np.array([h[0] for h in held])
        group = np.cumsum(np.concatenate([[0], seeds[1:] != seeds[:-1]]))
        flags = column_repeats([h[4] for h in held], np.array([h[3] for h in held]), group, length)
        out: list[list] = [[], [], [], [], []]
        for h, f in zip(held, flags):
            for a, b in zip(*true_runs(f)):
                for column, value in zip(out, (h[0], h[1], h[2], int(a), int(b))):
                    column.append(value)
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32())
        return pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(out, kinds)], ["seed", "span", "span2", "first", "last"])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        whole = 0  # rows of seeds that are complete
        for batch in batches:
            for row in zip(*(batch.column(k).to_pylist() for k in ("seed", "span", "span2", "off", "bytes"))):
                if held and held[-1][:3] == row[:3]:
                    continue
                if held and held[-1][0] != row[0]:
                    whole = len(held)
                    if whole >= batch_size:
                        yield flush(held)
                        held, whole = [], 0
                held.append(row)
        if held:
            yield flush(held)

    return compare


def _window_hashes(length: int):
    def explode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                data = batch.column("bytes")[row].as_py()
                n = len(data) - length + 1
                names = [xxhash.xxh3_128_digest(data[i : i + length]) for i in range(n)]
                fixed = [pa.array([batch.column(k)[row].as_py()] * n, pa.int64()) for k in ("seed", "span", "span2")]
                at = np.arange(n, dtype=np.int32)
                yield pa.RecordBatch.from_arrays([*fixed, pa.array(at), pa.array(at - batch.column("off")[row].as_py()), pa.array(names, pa.binary())], ["seed", "span", "span2", "first", "aligned", "window"])

    return explode


def repeated_ranges(docs: DataFrame, length: int = 400, seed: int = SEED, batch_size: int = BATCH) -> DataFrame:
    """Ranges of window starts that repeat: doc_id, ref, first, last (places in the text's bytes)."""
    spark = docs.sparkSession
    found = written(docs.mapInArrow(_emit(length, seed), SPANS), "spans")
    classes = found.groupBy("seed", "span", "span2").agg(F.count("*").alias("n"), F.min(F.struct("ref", "lo")).alias("one"), F.max(F.col("hi") - F.col("lo")).alias("width"))
    totals = classes.groupBy("seed").agg(F.sum("n").alias("members"), F.count("*").alias("kinds")).where("members > 1")
    classes = written(classes.join(totals, "seed"), "span_classes")
    whole = classes.where("n > 1").select("seed", "span", "span2", F.lit(0).alias("first"), F.col("width").alias("last"))

    mixed = classes.where("kinds > 1").select("seed", "span", "span2", "kinds", F.col("one.ref").alias("ref"), F.col("one.lo").alias("lo"))
    rows = mixed.select("ref", "lo").mapInArrow(_bytes_of_filter, "byte int, bits int").groupBy("byte").agg(F.expr("bit_or(bits)").alias("bits")).toArrow()  # FILTER_BITS / 8 rows at most
    bits = np.zeros(FILTER_BITS // 8, np.uint8)
    bits[rows["byte"].to_numpy()] = rows["bits"].to_numpy()
    strings = docs.mapInArrow(_emit(length, seed, spark.sparkContext.broadcast(bits.tobytes())), SPANS + ", bytes binary")
    strings = strings.select("ref", "lo", "seed", "span", "span2", "off", "bytes").join(mixed, ["seed", "span", "span2", "ref", "lo"]).drop("ref", "lo")
    strings = written(strings, "span_bytes")
    ranges = "seed long, span long, span2 long, first int, last int"
    few = strings.where(F.col("kinds") <= batch_size).repartition("seed").sortWithinPartitions("seed", "span", "span2")
    verdicts = whole.union(few.select("seed", "span", "span2", "off", "bytes").mapInArrow(_compare(length, batch_size), ranges))
    many = strings.where(F.col("kinds") > batch_size).dropDuplicates(["seed", "span", "span2"])
    hashed = many.select("seed", "span", "span2", "off", "bytes").mapInArrow(_window_hashes(length), "seed long, span long, span2 long, first int, aligned int, window binary")
    twice = hashed.groupBy("seed", "aligned", "window").agg(F.count("*").alias("n")).where("n > 1")
    verdicts = verdicts.union(hashed.join(twice, ["seed", "aligned", "window"]).select("seed", "span", "span2", "first", F.col("first").alias("last")))
    return found.join(verdicts, ["seed", "span", "span2"]).select("doc_id", "ref", (F.col("lo") + F.col("first")).alias("first"), (F.col("lo") + F.col("last")).alias("last"))


def _cut(length: int):
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                raw, at = utf8(part.column("text"))
                data, spans, kept = raw.tobytes(), [], []
                ranges = part.column("ranges").to_pylist()
                for d, found in enumerate(ranges):
                    lo, size = int(at[d]), int(at[d + 1] - at[d])
                    gone: list[list[int]] = []
                    for r in sorted((r["first"], r["last"] + length) for r in found or ()):
                        if gone and r[0] <= gone[-1][1]:
                            gone[-1][1] = max(gone[-1][1], r[1])
                        else:
                            gone.append(list(r))
                    ends = [0, *(x for r in gone for x in r), size]
                    kept.append(b"".join(data[lo + a : lo + b] for a, b in zip(ends[::2], ends[1::2])))
                    spans.append([{"start": a, "end": b} for a, b in gone])
                kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(np.diff(at)), pa.array(spans, kind), pa.array(kept, pa.binary())], ["doc_id", "n_bytes", "removed", "kept"])

    return cut


def suffix_dedup(docs: DataFrame, length: int = 400, seed: int = SEED, batch_size: int = BATCH) -> DataFrame:
    """Removes every byte covered by a ``length``-byte string that also starts elsewhere, in the same or another row's text.

    Takes ``(doc_id, text)``, other columns are ignored; returns one row per input row: doc_id, n_bytes, removed (maximal runs of bytes, start and
    end) and kept (the other bytes).  Null text counts as empty; texts shorter than ``length`` keep all; repeated rows and rows with equal
    or null doc_id are occurrences of their own, so they lose what they share; an empty table gives an empty result.
    """
    docs = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("ref", F.xxhash64("doc_id", "text"))
    ranges = repeated_ranges(docs, length, seed, batch_size)
    per_doc = ranges.groupBy(F.col("doc_id").alias("id"), F.col("ref").alias("of")).agg(F.collect_set(F.struct("first", "last")).alias("ranges"))
    rows = docs.join(per_doc, docs["doc_id"].eqNullSafe(F.col("id")) & (docs["ref"] == F.col("of")), "left").select("doc_id", "text", "ranges")
    kind = "doc_id long, n_bytes long, removed array<struct<start:int,end:int>>, kept binary"
    return rows.mapInArrow(_cut(length), kind)
