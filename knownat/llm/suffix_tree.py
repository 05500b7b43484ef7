"""Scores of texts by a probabilistic suffix tree over words.

Nodes are contexts of up to ``DEPTH`` preceding words.  A context and its next words are looked at if seen ``LEAST`` times, whatever the size of the
corpus, and a context is kept if its next-word distribution diverges from its longest kept suffix's: count * KL >= ``DIVERGENCE`` * ln(tokens).  A node
names the next words seen ``LEAST`` times after it; the mass of all others, and ``PRIOR`` more, goes to the distribution of the suffix.  The root is
add-one over all words.  The tree grows with the corpus, so it is a table of terms that add up to a token's log10 probability: one per word, one
per node, for the share that it gives to its suffix, and one per named next word.

A pair of a context and its next word is the context, one word longer, of the word after it: pairs are counted once per level, and only after contexts
seen so often that the divergence test can pass (``least_size``).  Blocks of texts send their different keys, cut into hashed buckets, as arrays.
Texts look up the most frequent terms in a table of fixed size and send a block's other keys to the terms once; bitmaps only spare keys that are surely in no term.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from knownat.llm.store import removed, tidied, written
from knownat.llm.text import bounds, mix, signed, slices, utf8, word_hashes

DEPTH = 3
LEAST = 2
DIVERGENCE = 2.0
PRIOR = 8.0
#: Most bits of a filter on keys; false positives cost time, not results.
FILTER_BITS = 1 << 28
#: Bytes of text made into tokens at a time; tokens, and texts, worked on at a time, a longer text alone; most terms that each task holds to look up.
SLICE = 500_000
BLOCK = 3 << 18
TEXTS_MOST = 1 << 15
FREQUENT = 1 << 20
#: A context seen more often is decided on without one task that holds all its pairs, and pairs that end in a pair seen more often know its probability at once.
HEAVY = 1 << 20
END = np.uint64(0x5851F42D4C957F2D)
START = np.uint64(0x14057B7EF767814F)
#: Tells a node's key in a table of all terms from the pair that is the same words.
NODE = np.uint64(0x2545F4914F6CDD1D)


def tokens_of(values: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Token hashes of all texts end to end, each text closed by its end token, and the n + 1 places where texts begin and end."""
    raw, at = utf8(values)
    start, end, words = bounds(raw, at)
    first = words + np.arange(len(words))
    out = np.full(int(first[-1]), END, np.uint64)
    doc = np.repeat(np.arange(len(first) - 1), np.diff(words))
    out[np.arange(len(start)) + doc] = word_hashes(raw, start, end)
    return out, first


def levels(tokens: np.ndarray, first: np.ndarray, depth: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For 1, 2, ... ``depth`` tokens before each token: hashes of this context, of the pair of one token less (at first the token) and of the pair.

    What lies before a text is a start token.  A token's pair is the next token's context on the level after.
    """
    up, start = tokens, np.array([START])
    for _ in range(depth):
        context = np.empty_like(up)
        context[1:] = up[:-1]
        context[first[:-1]] = start
        key = pair(context, up)
        yield context, up, key
        up, start = key, pair(start, start)


def find(table: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Place of each key in a sorted table, and whether it is there."""
    if not len(table):
        return np.zeros(len(keys), np.int64), np.zeros(len(keys), bool)
    at = np.minimum(np.searchsorted(table, keys), len(table) - 1)
    return at, table[at] == keys


def pair(context: np.ndarray, word: np.ndarray) -> np.ndarray:
    return mix(context + mix(word))


#: Kinds of rows on their way: (key, value) tables, pairs counted in a block, seen often enough, with their suffix's log10 probability, the same of a
#: context too large for one task, sizes of contexts, and, of a block of texts, words and keys of the tree asked for, each with its text, and the texts' sums.
TERM, PAIRS, NAMED, WEIGHED, OPEN, SIZES, WORDS, TREE, TEXTS = range(9)
PACKED = "bucket int, kind tinyint, block long, data binary"


def _packed(rows: list[tuple[int, int, int, bytes]]) -> pa.RecordBatch:
    """Rows of ``PACKED``."""
    columns = zip(*rows) if rows else [()] * 4
    kinds = (pa.int32(), pa.int8(), pa.int64(), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, kinds)], ["bucket", "kind", "block", "data"])


def _order(keys: np.ndarray) -> np.ndarray:
    """The order of hashes: sorted with their places in the low bits, which is faster than ``argsort``; hashes that differ in low bits only need that."""
    places = np.uint64((1 << max(1, len(keys)).bit_length()) - 1)
    packed = keys & ~places | np.arange(len(keys), dtype=np.uint64)
    packed.sort()
    order = (packed & places).astype(np.int64)
    there = keys[order]
    return np.argsort(keys) if (there[1:] < there[:-1]).any() else order


def _heads(ordered: np.ndarray) -> np.ndarray:
    """Where each different value of an ordered array begins."""
    return np.flatnonzero(np.diff(ordered, prepend=~ordered[:1]))


def _spread(kind: int, by: np.ndarray, columns: list[np.ndarray], buckets: int, block: int = 0) -> list[tuple[int, int, int, bytes]]:
    """Arrays cut into buckets by the high bits of ``by``, in its order: one row for each bucket, its columns end to end."""
    order = _order(by)
    by, columns = by[order], [c[order] for c in columns]
    of = ((by >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)
    at = np.flatnonzero(np.diff(of, prepend=-1))
    return [(int(of[lo]), kind, block, b"".join(c[lo:hi].tobytes() for c in columns)) for lo, hi in zip(at.tolist(), [*at[1:].tolist(), len(by)])]


def _columns(table: pa.Table, kind: int, types: tuple) -> list[np.ndarray]:
    """The columns of all rows of a kind, end to end."""
    width = sum(np.dtype(t).itemsize for t in types)
    out: list[list[np.ndarray]] = [[np.zeros(0, t)] for t in types]
    for blob in table.filter(pc.equal(table["kind"], kind))["data"].to_pylist():
        n, at = len(blob) // width, 0
        for column, t in zip(out, types):
            column.append(np.frombuffer(blob, t, n, at))
            at += n * np.dtype(t).itemsize
    return [np.concatenate(column) for column in out]


def _sent(table: DataFrame, kind: int, buckets: int) -> DataFrame:
    """A table of long keys, and values of eight bytes, as rows of ``PACKED``."""

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def sent():
            columns = [c.to_numpy() for c in pa.Table.from_batches(held).columns]
            return _packed(_spread(kind, columns[0].view(np.uint64), columns, buckets))

        for batch in batches:
            held.append(batch)
            if sum(b.num_rows for b in held) >= BLOCK:
                yield sent()
                held.clear()
        if sum(b.num_rows for b in held):
            yield sent()

    return table.mapInArrow(send, PACKED)


#: A key's three bits in its piece of a filter are named by its bits from these on.
SHIFTS = (0, 18, 36)


def _bits(keys: DataFrame, n: int) -> np.ndarray:
    """A Bloom filter of the column ``key``: eight to sixteen bits for each of ``n`` keys, at most ``FILTER_BITS``; one piece for each bucket of keys."""
    size = min(FILTER_BITS, 1 << max(16, (8 * n).bit_length())).bit_length() - 1
    cut = min(size - 16, (n >> 19).bit_length())

    def piece(table: pa.Table) -> pa.Table:
        (own,) = _columns(table, TERM, (np.uint64,))
        there = np.zeros(1 << (size - cut), bool)
        for shift in SHIFTS:
            there[(own >> np.uint64(shift)).astype(np.int64) & ((1 << (size - cut)) - 1)] = True
        return pa.table({"bucket": table["bucket"][:1], "data": pa.array([np.packbits(there, bitorder="little").tobytes()], pa.binary())})

    out = np.zeros((1 << cut, 1 << (size - cut - 3)), np.uint8)
    for row in _sent(keys.select("key"), TERM, 1 << cut).groupBy("bucket").applyInArrow(piece, "bucket int, data binary").toArrow().to_pylist():
        out[row["bucket"]] = np.frombuffer(row["data"], np.uint8)
    return out


def _maybe(bits: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Whether each key may be in the filter's table."""
    pieces, size = bits.shape
    flat, on = bits.ravel(), np.arange(len(keys))
    for shift in SHIFTS:
        own = keys[on]
        spot = (own >> np.uint64(shift)).astype(np.int64) & (8 * size - 1)
        at = ((own >> np.uint64(32)) * np.uint64(pieces) >> np.uint64(32)).astype(np.int64) * size + (spot >> 3)
        on = on[flat[at] >> (spot & 7).astype(np.uint8) & 1 == 1]
    out = np.zeros(len(keys), bool)
    out[on] = True
    return out


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list[pa.RecordBatch], np.ndarray, np.ndarray]]:
    """Rows, and their tokens as of ``tokens_of``, in blocks of about ``BLOCK`` tokens."""
    held, size = [], 0

    def block():
        at = np.cumsum([0, *(len(tokens) for _, tokens, _ in held)])
        ends = [first[1:] + before for (_, _, first), before in zip(held, at)]
        return [rows for rows, _, _ in held], np.concatenate([tokens for _, tokens, _ in held]), np.concatenate([[0], *ends])

    for part in (part.slice(lo, TEXTS_MOST) for batch in batches for part in slices(batch, "text", SLICE) for lo in range(0, part.num_rows, TEXTS_MOST)):
        tokens, first = tokens_of(part.column("text"))
        if held and (size + len(tokens) > BLOCK or sum(rows.num_rows for rows, _, _ in held) + part.num_rows > TEXTS_MOST):
            yield block()
            held, size = [], 0
        held.append((part, tokens, first))
        size += len(tokens)
    if held:
        yield block()


def _summed(by: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A place of each different key, in order, and its sum."""
    order = _order(by)
    heads = _heads(by[order])
    return order[heads], np.add.reduceat(n[order].astype(np.int64), heads) if len(heads) else np.zeros(0, np.int64)


def _words(docs: DataFrame, buckets: int) -> DataFrame:
    """Every token, column word, with its number n."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, tokens, _ in _blocks(batches):
            words, n = np.unique(tokens, return_counts=True)
            yield _packed(_spread(PAIRS, words, [words, n], buckets))

    def total(bucket: pa.Table) -> pa.Table:
        words, n = _columns(bucket, PAIRS, (np.uint64, np.int64))
        at, sums = _summed(words, n)
        return pa.table({"word": signed(words[at]), "n": sums})

    return docs.select("text").mapInArrow(count, PACKED).groupBy("bucket").applyInArrow(total, "word long, n long")


@dataclass
class _Level:
    """One level of the tree: what its pairs go through on their way, each step in hashed buckets.

    ``heavy`` has the contexts too large for one task and ``ups`` the pairs of one token less that too many pairs end in, with their log10 probability.
    """

    level: int
    buckets: int
    least_next: int
    floor: float
    heavy: np.ndarray
    ups: tuple[np.ndarray, np.ndarray]

    def pairs(self, docs: DataFrame, seen) -> DataFrame:
        """Pairs counted, by the hash of the pair, and sent on if seen often enough."""

        def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for _, tokens, first in _blocks(batches):
                *_, (context, up, key) = levels(tokens, first, self.level)
                hit = np.flatnonzero(_maybe(seen.value[0], context))
                hit = hit[_maybe(seen.value[1], up[hit])]
                order = _order(key[hit])
                at = hit[order]
                heads = _heads(key[at])
                n = np.diff(np.append(heads, len(at))).astype(np.uint32)
                at = at[heads]
                yield _packed(_spread(PAIRS, key[at], [context[at], up[at], n], self.buckets))

        return docs.select("text").mapInArrow(count, PACKED).groupBy("bucket").applyInArrow(lambda bucket: self._named(bucket), PACKED)

    def rows(self, named: DataFrame, logs: DataFrame, sizes: DataFrame) -> DataFrame:
        """Pairs sent on, with their suffixes' log10 probability, by the hash of the suffix, then with their contexts' sizes, by that of the context."""
        weighed = named.union(_sent(logs, TERM, self.fewer)).groupBy("bucket").applyInArrow(lambda bucket: self._suffixed(bucket), PACKED)
        kind = "kind string, key long, context long, n long, log double, value double"
        return weighed.union(_sent(sizes, SIZES, self.fewer)).groupBy("bucket").applyInArrow(lambda bucket: self._decided(bucket), kind)

    def _named(self, bucket: pa.Table) -> pa.Table:
        context, up, n = _columns(bucket, PAIRS, (np.uint64, np.uint64, np.uint32))
        at, n = _summed(pair(context, up), n)
        at, n = at[n >= self.least_next], n[n >= self.least_next]
        context, up = context[at], up[at]
        where, known = find(self.ups[0], up)
        rows = self._weighed(context[known], up[known], n[known], self.ups[1][where[known]])
        return pa.Table.from_batches([_packed(rows + _spread(NAMED, up[~known], [context[~known], up[~known], n[~known]], self.fewer))])

    @property
    def fewer(self) -> int:
        """Buckets of the pairs that are seen often enough."""
        return 1 + (self.buckets >> 2)

    def _weighed(self, context, up, n, suffix) -> list[tuple[int, int, int, bytes]]:
        large = find(self.heavy, context)[1]
        rows = []
        for kind, some, by in ((WEIGHED, ~large, context), (OPEN, large, pair(context, up))):
            rows += _spread(kind, by[some], [context[some], up[some], n[some], suffix[some]], self.fewer)
        return rows

    def _suffixed(self, bucket: pa.Table) -> pa.Table:
        keys, logs = _columns(bucket, TERM, (np.uint64, np.float64))
        context, up, n = _columns(bucket, NAMED, (np.uint64, np.uint64, np.int64))
        order = np.argsort(keys)
        at, there = find(keys[order], up)
        rows = self._weighed(context[there], up[there], n[there], logs[order[at[there]]])
        ready = bucket.filter(pc.is_in(bucket["kind"], pa.array([WEIGHED, OPEN], pa.int8())))
        return pa.Table.from_batches([*ready.to_batches(), _packed(rows)])

    def _decided(self, bucket: pa.Table) -> pa.Table:
        """Pairs, log their probability here and value their term, null if their context is not kept; nodes; and, log that of the suffix, open pairs."""
        known, sizes = _columns(bucket, SIZES, (np.uint64, np.int64))
        types = (np.uint64, np.uint64, np.int64, np.float64)
        context, up, n, suffix = _columns(bucket, WEIGHED, types)
        order = np.argsort(known)
        at, there = find(known[order], context)
        at, context, up, n, suffix = at[there], context[there], up[there], n[there], suffix[there]
        by = np.argsort(context)
        context, up, n, suffix, size = context[by], up[by], n[by], suffix[by], sizes[order[at[by]]] if len(by) else n
        heads = _heads(context)
        group = np.repeat(np.arange(len(heads)), np.diff(np.append(heads, len(context))))
        total = lambda x: np.bincount(group, x, len(heads))
        size = size[heads]
        share = (size - total(n) + PRIOR) / (size + PRIOR)
        own = n / (size + PRIOR)[group] + share[group] * 10.0**suffix
        # the part of the divergence that the named words carry, and the part that all others share
        told = total(own * (np.log(own) - suffix * math.log(10)))
        kept = size * (told + np.maximum(1 - total(own), 0) * np.log(share)) >= self.floor
        back, keeps = np.log10(share), kept[group]
        log = np.where(keeps, np.log10(own), suffix)
        pairs = {"kind": ["pair"] * len(log), "key": signed(pair(context, up)), "context": pa.nulls(len(log), pa.int64()), "n": n, "log": log, "value": pa.array(log - suffix - back[group], mask=~keeps)}
        nodes = {"kind": ["node"] * int(kept.sum()), "key": signed(context[heads][kept]), "context": pa.nulls(int(kept.sum()), pa.int64()), "n": size[kept], "log": back[kept], "value": back[kept]}
        context, up, n, suffix = _columns(bucket, OPEN, types)
        left = {"kind": ["open"] * len(n), "key": signed(pair(context, up)), "context": signed(context), "n": n, "log": suffix, "value": pa.nulls(len(n), pa.float64())}
        return pa.concat_tables([pa.table(x, schema=ROWS) for x in (pairs, nodes, left)])


ROWS = pa.schema({"kind": pa.string(), "key": pa.int64(), "context": pa.int64(), "n": pa.int64(), "log": pa.float64(), "value": pa.float64()})


def _decided(left: DataFrame, sizes: DataFrame, floor: float) -> DataFrame:
    """What ``_Level.rows`` says of open pairs, without a task that holds a context's pairs."""
    share = (F.col("size") - F.col("told") + PRIOR) / (F.col("size") + PRIOR)
    sized = sizes.select(F.col("key").alias("context"), F.col("n").alias("size")).join(left.groupBy("context").agg(F.sum("n").alias("told")), "context")
    own = F.col("n") / (F.col("size") + PRIOR) + F.col("share") * F.pow(F.lit(10.0), "log")
    rows = left.join(sized.withColumn("share", share), "context").withColumn("own", own)
    told = F.sum(F.col("own") * (F.log("own") - F.col("log") * math.log(10)))
    sums = rows.groupBy("context").agg(F.first("size").alias("size"), F.first("share").alias("share"), told.alias("told"), F.sum("own").alias("own"))
    passed = sums.where(F.col("size") * (F.col("told") + F.greatest(1 - F.col("own"), F.lit(0.0)) * F.log("share")) >= floor)
    nodes = written(passed.select("context", F.log10("share").alias("back"), "size"), "nodes", tidy=True)
    joined = rows.join(nodes.select("context", "back"), "context", "left")
    log = F.when(F.col("back").isNull(), F.col("log")).otherwise(F.log10("own"))
    pairs = joined.select(F.lit("pair").alias("kind"), "key", "context", "n", log.alias("log"), (log - F.col("log") - F.col("back")).alias("value"))
    return pairs.union(nodes.select(F.lit("node"), "context", "context", "size", "back", "back"))


def _bytes(docs: DataFrame) -> int:
    """Bytes of all texts."""
    return docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0


def least_size(total: int, distinct: int, divergence: float = DIVERGENCE) -> int:
    """The least count of a context that can pass the divergence test.

    A node mixes its named next words' shares E with its suffix's distribution Q, so its KL is at most size / (size + ``PRIOR``) of E's, which is at most
    -ln of the least Q(w).  Q(w) of a word seen ``LEAST`` times is at least 3 / (total + distinct + 1) in the root and 2 / (total + ``PRIOR``) in a node.
    """
    most, size = math.log((total + distinct + PRIOR + 1) / 2), 1
    while size * size / (size + PRIOR) * most * (1 + 1e-6) < divergence * math.log(max(2, total)):
        size += 1
    return size


@dataclass
class SuffixTree:
    """``counts`` has every word's count, ``terms`` the tree: key, value and count n, with kind "node" (key of a context) or "pair" (of a context and a next word)."""

    counts: DataFrame
    tokens: int
    distinct: int
    depth: int
    terms: DataFrame

    def _collected(self, kind: str) -> tuple[np.ndarray, np.ndarray]:
        rows = self.terms.where(F.col("kind") == kind).toArrow()
        keys = rows["key"].to_numpy().view(np.uint64)
        order = np.argsort(keys)
        return keys[order], rows["value"].to_numpy()[order]

    # what follows brings a tree to the driver, to look at a small one; scoring does not use it

    @cached_property
    def _nodes(self) -> tuple[np.ndarray, np.ndarray]:
        return self._collected("node")

    @cached_property
    def _pairs(self) -> tuple[np.ndarray, np.ndarray]:
        return self._collected("pair")

    @property
    def nodes(self) -> np.ndarray:
        """Sorted context hashes."""
        return self._nodes[0]

    @property
    def pairs(self) -> np.ndarray:
        """Sorted hashes of (context, next word)."""
        return self._pairs[0]

    def gains(self, tokens: np.ndarray, first: np.ndarray) -> np.ndarray:
        """What the kept contexts of each token add to its root score."""
        out = np.zeros(len(tokens))
        for context, _, key in levels(tokens, first, self.depth):
            for (keys, values), wanted in ((self._nodes, context), (self._pairs, key)):
                at, there = find(keys, wanted)
                out[there] += values[at[there]]
        return out


def learn(docs: DataFrame, depth: int = DEPTH, context_share: float = 0.0, next_share: float = 0.0, divergence: float = DIVERGENCE) -> SuffixTree:
    """Counts all texts of ``docs`` and builds the tree.  The two shares of all tokens, if given, raise ``LEAST`` for contexts and next words."""
    if depth < 1:
        raise ValueError("depth is 1 at least")
    spark = docs.sparkSession
    counts = written(_words(docs, 1 + (_bytes(docs) >> 23)), "word_counts", tidy=True)
    of_ends = F.sum(F.when(F.col("word") == int(END.view(np.int64)), F.col("n")))
    total, distinct, texts = (x or 0 for x in counts.agg(F.sum("n"), F.count("*"), of_ends).first())
    least_next = max(LEAST, math.ceil(next_share * total))
    least = max(least_next, math.ceil(context_share * total), least_size(total, distinct, divergence))
    floor = divergence * math.log(max(2, total))
    # the next words of a level, with their log10 probability; a pair seen often enough has a suffix seen often enough
    root = F.log10((F.col("n") + 1) / F.lit(float(total + distinct + 1)))
    shorter = counts.where(F.col("n") >= least_next).select(F.col("word").alias("key"), "n", root.alias("log"))
    terms = spark.createDataFrame([], "kind string, key long, value double, n long")
    start = np.array([START])
    for level in range(1, depth + 1):
        before = spark.range(1).select(F.lit(int(start.view(np.int64)[0])).alias("key"), F.lit(texts).cast("long").alias("n"))
        sizes = shorter.select("key", "n").union(before).where(F.col("n") >= least)
        often, heavy = F.col("n") >= least, F.col("n") > HEAVY
        known, contexts, candidates, most = (x or 0 for x in shorter.agg(F.count("*"), F.count_if(often), F.sum(F.when(often, F.col("n"))), F.max("n")).first())
        ups, large = (np.zeros(0, np.uint64), np.zeros(0)), np.zeros(0, np.uint64)
        if max(most, texts) > HEAVY:
            keys, logs = (c.to_numpy() for c in shorter.where(heavy).select("key", "log").toArrow().columns)
            order = np.argsort(keys.view(np.uint64))
            ups = (keys.view(np.uint64)[order], logs[order])
            large = np.sort(sizes.where(heavy).select("key").toArrow()["key"].to_numpy().view(np.uint64))
        step = _Level(level, 1 + ((candidates + texts) >> 19), least_next, floor, large, ups)
        with tidied(spark):
            seen = spark.sparkContext.broadcast((_bits(sizes, 4 * contexts + 4), _bits(shorter, known)))
        named = written(step.pairs(docs, seen), "named", tidy=True)
        rows = step.rows(named, shorter.where(~heavy).select("key", "log"), sizes.where(~heavy))
        rows = written(rows, "decided", tidy=True)
        removed(named)
        if len(large):
            rows = rows.where("kind <> 'open'").union(written(_decided(rows.where("kind = 'open'"), sizes.where(heavy), floor), "decided", tidy=True))
        shorter = rows.where("kind = 'pair'").select("key", "n", "log")
        terms = terms.union(rows.where("kind = 'node' or kind = 'pair' and value is not null").select("kind", "key", "value", "n"))
        start = pair(start, start)
    return SuffixTree(counts, total, distinct, depth, terms)


def _asked(depth: int, buckets: int, shared):
    """Per block: what is not among the frequent, each occurrence with its text, cut into buckets, and its texts' sums of the others."""

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of_nodes, of_pairs, keys, values = shared.value
        for ordinal, (rows, tokens, first) in enumerate(_blocks(batches)):
            n = len(first) - 1
            doc = np.repeat(np.arange(n, dtype=np.uint16), np.diff(first))
            asked, known, base, gain = {WORDS: [], TREE: []}, np.zeros(n, np.int64), np.zeros(n), np.zeros(n)

            def look(own, inverse, of, kind):
                """Numbers and sums of the frequent among the occurrences ``own[inverse]`` in the texts ``of``; the others are asked for."""
                at, there = find(keys, own)
                found = there[inverse]
                asked[kind].append((own[inverse[~found]], of[~found]))
                return np.bincount(of[found], minlength=n), np.bincount(of[found], values[at[inverse[found]]], n)

            # a pair is the next token's context on the level after: both are looked up together
            start, context = np.array([START]), None
            for level, key in enumerate(itertools.chain([tokens], (key for _, _, key in levels(tokens, first, depth)))):
                as_pair, as_node = np.ones(len(tokens), bool), np.zeros(len(tokens), bool)
                if level:
                    as_pair = context
                    as_pair[context] = _maybe(of_pairs, key[context])
                if level < depth:
                    as_node = _maybe(of_nodes, key ^ NODE)
                    as_node[first[1:] - 1] = False
                hit = np.flatnonzero(as_pair | as_node)
                order = _order(key[hit])
                heads = _heads(key[hit[order]])
                own, inverse = key[hit[order[heads]]], np.empty(len(hit), np.int64)
                inverse[order] = np.repeat(np.arange(len(heads)), np.diff(np.append(heads, len(hit))))
                on = as_pair[hit]
                number, sums = look(own, inverse[on], doc[hit[on]], TREE if level else WORDS)
                if level:
                    gain += sums
                else:
                    known, base = number, sums
                if level < depth:
                    on = as_node[hit]
                    by = _order(own ^ NODE)
                    place = np.empty_like(by)
                    place[by] = np.arange(len(by))
                    gain += look((own ^ NODE)[by], place[inverse[on]], doc[hit[on]], TREE)[1]
                    there = _maybe(of_nodes, start ^ NODE)[0]
                    if there:
                        gain += look(start ^ NODE, np.zeros(n, np.int64), np.arange(n, dtype=np.uint16), TREE)[1]
                    context = np.empty(len(tokens), bool)
                    context[1:] = as_node[:-1]
                    context[first[:-1]] = there
                    start = pair(start, start)
            texts = {"doc_id": pa.chunked_array([r.column("doc_id") for r in rows]), "n_tokens": np.diff(first), "known": known, "base": base, "gain": gain}
            block, out = (TaskContext.get().partitionId() << 32) + ordinal, []
            for kind, parts in asked.items():
                key, of = (np.concatenate(x) for x in zip(*parts))
                out += _spread(kind, key, [key, of], buckets, block)
                if kind == WORDS:
                    texts["asked"] = np.bincount(of, minlength=n)
            sink, table = pa.BufferOutputStream(), pa.table(texts).combine_chunks()
            with pa.ipc.new_stream(sink, table.schema) as stream:
                stream.write_table(table)
            yield _packed([(block % buckets, TEXTS, block, sink.getvalue().to_pybytes()), *out])

    return ask


def _answered(bucket: pa.Table) -> pa.Table:
    """Of the keys asked for, how many of each text's are terms, and the sum of their values; the texts go on as they are."""
    keys, values = _columns(bucket, TERM, (np.uint64, np.float64))
    order = _order(keys)
    keys, values = keys[order], values[order]
    out = []
    for kind in (WORDS, TREE):
        some = bucket.filter(pc.equal(bucket["kind"], kind))
        key, of = _columns(some, kind, (np.uint64, np.uint16))
        sizes = pc.binary_length(some["data"]).to_numpy() // 10
        at, there = find(keys, key)
        text = (np.repeat(np.arange(len(sizes)), sizes)[there] << 16) + of[there]
        value = values[at[there]]
        order = np.argsort(text, kind="stable")
        text = text[order]
        heads = _heads(text)
        found = np.diff(np.append(heads, len(text))).astype(np.uint32)
        sums = np.add.reduceat(value[order], heads) if len(heads) else np.zeros(0)
        text = text[heads]
        cuts = np.searchsorted(text >> 16, np.arange(len(sizes) + 1)).tolist()
        of = (text & 0xFFFF).astype(np.uint16)
        for block, lo, hi in zip(some["block"].to_pylist(), cuts, cuts[1:]):
            if hi > lo:
                columns = [of[lo:hi], found[lo:hi], sums[lo:hi]]
                out.append((0, kind, block, b"".join(c.tobytes() for c in columns)))
    ready = bucket.filter(pc.equal(bucket["kind"], TEXTS))
    return pa.Table.from_batches([*ready.to_batches(), _packed(out)])


def _finished(unknown: float):
    """Adds what a block was told to its texts' sums."""

    def add(block: pa.Table) -> pa.Table:
        (blob,) = block.filter(pc.equal(block["kind"], TEXTS))["data"].to_pylist()
        texts = pa.ipc.open_stream(blob).read_all()
        n = texts.num_rows
        known, base, gain, asked = (texts[c].to_numpy() for c in ("known", "base", "gain", "asked"))
        of, found, sums = _columns(block, WORDS, (np.uint16, np.uint32, np.float64))
        found = np.bincount(of, found, n).astype(np.int64)
        base = base + np.bincount(of, sums, n) + unknown * (asked - found)
        of, _, sums = _columns(block, TREE, (np.uint16, np.uint32, np.float64))
        return pa.table({"doc_id": texts["doc_id"], "n_tokens": texts["n_tokens"], "n_known": known + found, "base_score": base, "score": base + gain + np.bincount(of, sums, n)})

    return add


def scored(docs: DataFrame, model: SuffixTree) -> DataFrame:
    """``(doc_id, text)`` to doc_id, n_tokens, n_known, train_tokens, base_score (the root's) and score (the tree's), both log10.

    Null and empty texts are one end token; repeated rows are scored each; an empty training set leaves an empty tree, in which every
    word has probability 1; an empty table gives an empty result; other columns are ignored.
    """
    spark, bottom = docs.sparkSession, float(model.tokens + model.distinct + 1)
    salted = F.when(F.col("kind") == "node", F.col("key").bitwiseXOR(F.lit(int(NODE.view(np.int64))))).otherwise(F.col("key"))
    words = model.counts.select(F.lit("word").alias("kind"), F.col("word").alias("key"), F.log10((F.col("n") + 1) / F.lit(bottom)).alias("value"), "n")
    entries = words.union(model.terms.select("kind", salted.alias("key"), "value", "n"))
    with tidied(spark):
        steps = entries.groupBy("kind", F.floor(4 * F.log2("n")).alias("step")).agg(F.min("n").alias("n"), F.count("*").alias("rows")).collect()
        number = {kind: sum(r["rows"] for r in steps if r["kind"] == kind) for kind in ("word", "node", "pair")}
        steps.sort(key=lambda r: -r["n"])
        often = min((r["n"] for r, held in zip(steps, np.cumsum([r["rows"] for r in steps])) if held <= FREQUENT), default=1 << 62)
        top = entries.where(F.col("n") >= often).select("key", "value").toArrow()
        keys, values = top["key"].to_numpy().view(np.uint64), top["value"].to_numpy()
        order = np.argsort(keys)
        filters = [_bits(entries.where(F.col("kind") == kind), size) for kind, size in (("node", 4 * number["node"]), ("pair", number["pair"]))]
        shared = spark.sparkContext.broadcast((*filters, keys[order], values[order]))
    buckets = 1 + (_bytes(docs) >> 23) + (sum(number.values()) >> 19)
    asked = docs.select("doc_id", "text").mapInArrow(_asked(model.depth, buckets, shared), PACKED)
    told = _sent(entries.where(F.col("n") < often).select("key", "value"), TERM, buckets)
    given = asked.union(told).groupBy("bucket").applyInArrow(_answered, PACKED)
    out = given.groupBy("block").applyInArrow(_finished(-math.log10(bottom)), "doc_id long, n_tokens long, n_known long, base_score double, score double")
    return out.select("doc_id", "n_tokens", "n_known", F.lit(model.tokens).cast("long").alias("train_tokens"), "base_score", "score")
