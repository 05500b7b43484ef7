"""N-gram Jaccard join: documents whose word-shingle sets are similar enough, and the groups that such links form.

Grouped prefix join.  Documents with the same set are one class; classes with the same prefix and size are one group, and only one prefix
per group is posted.  A prefix is the part of the set, in a global order, of which two linked sets must share an element.  The order is
(how often a counting sketch over all documents saw the shingle's bucket, hash): common passages come last and so rarely into a prefix.
Components are then found in two steps.  First every group on a posting list is compared with one leader of the list and every class with its
group's head; that joins nearly all near copies without making pairs of a group.  Then, on the lists that still hold several components, the classes
meet with their signatures, in cells of two blocks of about ``BLOCK`` so that no task holds a long list whole.  A first sweep takes from each cell only the
closest pairs that would join its components, fewer than the cell has rows; a second one takes every pair of classes from different components that
signatures allow, on the lists where the first left some out.  Pairs inside one component cannot change the components.  ``links()`` has them too: it verifies every pair of classes that share a
posted token.  All lists of one leader are one list, so a class travels once for each leader it meets and not for each token.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from knownat.llm.components import components
from knownat.llm.store import written
from knownat.llm.text import runs, signed, slices, utf8, words

#: Buckets of the counting sketch that orders the shingles.
SKETCH = 1 << 20
#: Buckets that travel as one value.
SKETCH_BLOCK = 1 << 12
#: Bits of the filter on candidate document ids; false positives cost time, not results.
FILTER_BITS = 1 << 24
#: Bits of a set's signature for each shingle, at least; every shingle flips one bit.
SIGNATURE = 2
#: 64-bit words of signatures that are compared at a time.
AT_ONCE = 1 << 20
#: Classes of a list in one block; two blocks meet in a cell.
BLOCK = 1024


def shingle_sets(texts: pa.Array, width: int) -> Iterator[np.ndarray]:
    """Sorted distinct shingle hashes of each text."""
    raw, at = utf8(texts)
    found = words(raw, at)
    hashes, begins = runs(found.hash, found.first, width)
    for lo, hi in zip(begins, begins[1:]):
        yield np.unique(hashes[lo:hi])


def _sketch(width: int):
    """Counts of a task by block of the sketch; first the low bytes of a block's counts, then the higher ones, which are mostly zero."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(SKETCH, "<i8")
        for batch in batches:
            for part in slices(batch, "text"):
                hashes = np.concatenate(list(shingle_sets(part.column("text"), width)))
                total += np.bincount((hashes >> np.uint64(44)).astype(np.int64), minlength=SKETCH)
        blocks = total.reshape(-1, SKETCH_BLOCK)
        seen = np.flatnonzero(blocks.any(axis=1))
        planes = (np.ascontiguousarray(b.view(np.uint8).reshape(-1, 8).T).tobytes() for b in blocks[seen])
        yield pa.RecordBatch.from_arrays([pa.array(seen.astype(np.int32)), pa.array(list(planes), pa.binary())], ["block", "counts"])

    return count


def _ranks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums the counts of every block: the order of magnitude of each, one byte a bucket."""
    totals: dict[int, np.ndarray] = {}
    for batch in batches:
        for block, counts in zip(batch.column("block").to_pylist(), batch.column("counts").to_pylist()):
            n = np.ascontiguousarray(np.frombuffer(counts, np.uint8).reshape(8, -1).T).view("<i8").ravel()
            totals[block] = totals[block] + n if block in totals else n
    ranks = [np.log2(np.maximum(n, 1)).astype(np.uint8).tobytes() for n in totals.values()]
    yield pa.RecordBatch.from_arrays([pa.array(list(totals), pa.int32()), pa.array(ranks, pa.binary())], ["block", "ranks"])


def _order(docs: DataFrame, width: int) -> np.ndarray:
    """One byte per sketch bucket: the order of magnitude of its count over all documents."""
    counts = docs.select("text").mapInArrow(_sketch(width), "block int, counts binary").repartition("block")
    order = np.zeros((SKETCH // SKETCH_BLOCK, SKETCH_BLOCK), np.uint8)
    for row in counts.mapInArrow(_ranks, "block int, ranks binary").collect():  # at most SKETCH / SKETCH_BLOCK rows
        order[row.block] = np.frombuffer(row.ranks, np.uint8)
    return order.ravel()


def signature(s: np.ndarray) -> np.ndarray:
    """Parity of the number of shingles on each bit: two sets differ in at least as many shingles as their signatures do in bits.

    The number of bits is a power of two; the halves of a signature, xored, are the signature of the same set with half the bits.
    """
    width = 64 << max(0, SIGNATURE * len(s) - 1 >> 6).bit_length()
    odd = np.bincount((s & np.uint64(width - 1)).astype(np.int64), minlength=width) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


class Signatures:
    """A column of signatures, by number of words; longer ones are folded to be compared with shorter ones."""

    def __init__(self, column: pa.ListArray):
        flat, begins = column.flatten().to_numpy().view(np.uint64), np.concatenate([[0], np.cumsum(column.value_lengths().to_numpy())])
        self.words = np.diff(begins)
        self.of: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        rows, table, above = np.zeros(0, np.int64), None, 0
        for width in np.unique(self.words)[::-1].tolist():
            while above > width:
                above //= 2
                table = table[:, :above] ^ table[:, above:]
            own = np.flatnonzero(self.words == width)
            fresh = flat[begins[own][:, None] + np.arange(width)]
            rows, table, above = np.concatenate([rows, own]), fresh if table is None else np.concatenate([table, fresh]), width
            place = np.full(len(self.words), -1)
            place[rows] = np.arange(len(rows))
            self.of[width] = place, table

    def differ(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Bits in which the signatures of rows ``x`` and ``y`` differ."""
        out, least = np.zeros(len(x), np.int64), np.minimum(self.words[x], self.words[y])
        for width in np.unique(least).tolist():
            place, table = self.of[width]
            which = np.flatnonzero(least == width)
            for part in np.array_split(which, -(-len(which) * width // AT_ONCE)):
                out[part] = np.bitwise_count(table[place[x[part]]] ^ table[place[y[part]]]).sum(axis=1, dtype=np.int64)
        return out


def _may_link(n: np.ndarray, m: np.ndarray, differ: np.ndarray, percent: int) -> np.ndarray:
    """Whether sets of sizes ``n`` and ``m`` that differ in so many shingles at least can be similar enough."""
    return (n + m - differ) * (100 + percent) >= 2 * percent * (n + m)


def _describe(width: int, percent: int, order):
    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                sizes, names, prefixes, signatures = [], [], [], []
                for s in shingle_sets(part.column("text"), width):
                    keep = len(s) - -(-percent * len(s) // 100) + 1 if len(s) else 0
                    ranked = np.lexsort((s, order.value[(s >> np.uint64(44)).astype(np.int64)]))[:keep]
                    sizes.append(len(s))
                    names.append(xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None)
                    prefixes.append(signed(s[ranked]))
                    signatures.append(signature(s))
                ends = np.concatenate([[0], np.cumsum([len(p) for p in prefixes])]).astype(np.int32)
                prefix = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(prefixes)))
                ends = np.concatenate([[0], np.cumsum([len(p) for p in signatures])]).astype(np.int32)
                whole = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(signatures)))
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(names, pa.binary()), prefix, whole],
                    ["doc_id", "n_shingles", "set_hash", "prefix", "signature"],
                )

    return describe


def _sets_of(width: int, wanted):
    """Sets of the documents whose id passes the filter."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.frombuffer(wanted.value, np.uint8)
        for batch in batches:
            bucket = batch.column("bucket").to_numpy()
            batch = batch.filter(pa.array((bits[bucket >> 3] >> (bucket & 7).astype(np.uint8)) & 1 == 1))
            for part in slices(batch, "text"):
                sets = [signed(s) for s in shingle_sets(part.column("text"), width)]
                ends = np.concatenate([[0], np.cumsum([len(s) for s in sets])]).astype(np.int32)
                names = [xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None for s in sets]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(names, pa.binary()), pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(sets)))], ["set_hash", "shingles"]
                )

    return emit


def _filter_bits(ids: DataFrame) -> bytes:
    """A bitmap of hashed ids, built by or-ing bytes in Spark; its size is fixed."""
    spots = ids.select(F.pmod(F.xxhash64("doc_id"), F.lit(FILTER_BITS)).alias("spot")).distinct()
    spots = spots.groupBy(F.expr("spot div 8").cast("int").alias("byte")).agg(F.expr("bit_or(shiftleft(1, cast(spot as int) % 8))").alias("bits"))
    rows = spots.toArrow()  # at most FILTER_BITS / 8 rows
    out = np.zeros(FILTER_BITS // 8, np.uint8)
    out[rows["byte"].to_numpy()] = rows["bits"].to_numpy()
    return out.tobytes()


def _fits(percent: int, a: str, b: str):
    """Sizes that can reach the similarity at all."""
    return (F.least(a, b) * 100 >= F.greatest(a, b) * percent)


def _forest(a: np.ndarray, b: np.ndarray, cost: np.ndarray) -> np.ndarray:
    """Places of the edges ``(a, b)`` of a cheapest spanning forest (Boruvka's rounds; of equal costs the earlier edge is cheaper)."""
    order = np.argsort(cost, kind="stable")
    ends = np.stack([a, b])[:, order]
    root, live, kept = np.arange(ends.max(initial=-1) + 1), np.arange(len(order)), [np.zeros(0, np.int64)]
    while len(live := live[(apart := root[ends[:, live]])[0] != apart[1]]):
        u, v = root[ends[:, live]]
        best = np.full(len(root), len(order))
        np.minimum.at(best, u, live)
        np.minimum.at(best, v, live)
        tree = np.flatnonzero(best < len(order))
        kept.append(np.unique(best[tree]))
        to, (u, v) = np.arange(len(root)), root[ends[:, best[tree]]]
        to[tree] = np.where(u == tree, v, u)
        to[tree] = np.where((to[to[tree]] == tree) & (tree < to[tree]), tree, to[tree])  # of two that chose the same edge one stays
        while (far := to[to]).tolist() != to.tolist():
            to = far
        root = to[root]
    return order[np.concatenate(kept)]


def _close(cells: pa.Table, percent: int, forest: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Of rows in order of their cells, the pairs ``(a, b)``, a < b, of classes of different components that sizes and signatures allow.

    With ``forest`` only the closest that join the same components of a cell.  Also the lists of cells from which pairs are left out.
    """
    at, lo, hi, own, cid, n, comp = (cells.column(k).to_numpy() for k in ("list", "lo", "hi", "own", "cid", "n", "comp"))
    signatures = Signatures(cells.column("signature").combine_chunks())
    fresh = np.flatnonzero((at[1:] != at[:-1]) | (lo[1:] != lo[:-1]) | (hi[1:] != hi[:-1])) + 1
    ends = np.append(fresh, len(at))
    end = np.repeat(ends, np.diff(ends, prepend=0))
    x, step, found, far = np.arange(len(at)), 1, [np.zeros((0, 2), np.int64)], [np.zeros(0)]
    while len(x := x[x + step < end[x]]):  # each row with the row so many steps on in its cell
        y = x + step
        apart = (comp[x] != comp[y]) & ((own[x] != own[y]) | (lo[x] == hi[x])) & (np.minimum(n[x], n[y]) * 100 >= np.maximum(n[x], n[y]) * percent)
        a, b = x[apart], y[apart]
        differ = signatures.differ(a, b)
        near = _may_link(n[a], n[b], differ, percent)
        a, b = a[near], b[near]
        found.append(np.stack([a, b], 1))
        far.append(differ[near] / (n[a] + n[b]))
        step += 1
    pairs, more = np.concatenate(found), np.zeros(0, np.int64)
    if forest:
        node = np.unique(np.stack([end, comp], 1), axis=0, return_inverse=True)[1].ravel()
        tree = _forest(node[pairs[:, 0]], node[pairs[:, 1]], np.concatenate(far))
        more, pairs = np.unique(at[np.delete(pairs[:, 0], tree)]), pairs[tree]
    return np.unique(np.sort(cid[pairs], axis=1), axis=0), more


def _pairs_allowed(percent: int):
    """Of pairs with both sizes and signatures, those that signatures allow."""

    def allowed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x = np.arange(batch.num_rows)
                differ = Signatures(pa.concat_arrays([batch.column("of_a"), batch.column("of_b")])).differ(x, x + batch.num_rows)
                near = _may_link(batch.column("a_n").to_numpy(), batch.column("b_n").to_numpy(), differ, percent)
                yield batch.select(["a", "b"]).filter(pa.array(near))

    return allowed


def _allowed(percent: int, forest: bool = False):
    """``_close`` of whole cells; the last cell of a batch may go on in the next.  With ``forest`` a row without a pair names a list with more."""

    def allowed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def pairs(rows: pa.Table) -> pa.RecordBatch:
            found, more = _close(rows, percent, forest)
            out = pa.RecordBatch.from_arrays([pa.array(found[:, 0]), pa.array(found[:, 1])], ["a", "b"])
            if not forest:
                return out
            named = pa.RecordBatch.from_arrays([pa.nulls(len(more), pa.int64()), pa.nulls(len(more), pa.int64()), pa.array(more)], ["a", "b", "list"])
            return pa.concat_batches([out.append_column("list", pa.nulls(len(found), pa.int64())), named])

        open_cell: list[pa.RecordBatch] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            at, lo, hi = (batch.column(k).to_numpy() for k in ("list", "lo", "hi"))
            last = int(np.argmax((at == at[-1]) & (lo == lo[-1]) & (hi == hi[-1])))
            same = open_cell and all(open_cell[0].column(k)[0] == batch.column(k)[0] for k in ("list", "lo", "hi"))
            if last or open_cell and not same:
                yield pairs(pa.Table.from_batches([*open_cell, batch.slice(0, last)]))
                open_cell = []
            open_cell.append(batch.slice(last))
        if open_cell:
            yield pairs(pa.Table.from_batches(open_cell))

    return allowed


class JaccardJoin:
    """The join over one table of documents ``(doc_id, text)``; other columns are ignored.

    ``members`` has one row per input row: doc_id, n_shingles, component_id.  ``links()`` has every pair of different sets
    that are similar enough, and ``link_counts()`` their number for every input row; both are worked out when first asked for.
    Null and blank texts have no shingles and link with nothing (component_id is their own doc_id); a text of fewer than ``width`` words is
    one shingle; rows with equal sets are one class, repeated rows included; an empty table gives empty results.
    """

    def __init__(self, docs: DataFrame, width: int = 5, percent: int = 75):
        self.spark, self.width, self.percent = docs.sparkSession, width, percent
        self.docs = docs.select("doc_id", "text")
        order = self.spark.sparkContext.broadcast(_order(self.docs, width))
        described = self.docs.mapInArrow(_describe(width, percent, order), "doc_id long, n_shingles long, set_hash binary, prefix array<long>, signature array<long>")
        described = written(described.withColumn("row", F.monotonically_increasing_id()), "described")
        self.described = described.select("doc_id", "n_shingles", "set_hash")
        self.signatures = described.where("set_hash is not null").select("row", "signature")
        # equal sets have equal sizes and prefixes; a prefix travels as its hashes, and as itself only for the one row that posts it
        same = F.struct("n_shingles", F.xxhash64("prefix"), F.hash("prefix"))
        rows = described.where("set_hash is not null").select("doc_id", "set_hash", F.col("n_shingles").alias("n"), same.alias("same"), "row")
        classes = rows.groupBy("set_hash").agg(*[F.min(c).alias(c) for c in ("doc_id", "n", "same", "row")])
        classes = written(classes.withColumn("cid", F.monotonically_increasing_id()), "classes")
        heads = classes.groupBy("same").agg(F.min(F.struct("cid", "row")).alias("head")).select("same", F.col("head.cid").alias("gid"), F.col("head.row").alias("row"))
        self.classes = written(classes.join(heads.drop("row"), "same").select("cid", "gid", "n", "doc_id", "set_hash", "row"), "grouped")
        posted = described.select("row", F.col("n_shingles").alias("n"), "prefix").join(heads.select("row", "gid"), "row")
        postings = posted.select(F.explode("prefix").alias("token"), "gid", "n")
        # of all lists only those on which two groups stand are kept, with their leader
        per_token = Window.partitionBy("token")
        lead = F.min(F.struct(F.hash("gid").alias("at"), F.col("gid").alias("lead"), F.col("n").alias("lead_n"))).over(per_token)
        # a list is named by its leader, so tokens of about the same groups make one list; that more groups meet on it costs time, not results
        listed = postings.withColumn("first", lead).withColumn("size", F.count(F.lit(1)).over(per_token)).where("size > 1")
        self.listed = written(listed.select(F.col("first.lead").alias("list"), "gid", "n", "first.lead_n").distinct(), "listed")
        self._solve()

    def _possible(self, pairs: DataFrame) -> DataFrame:
        """Of the class pairs ``(a, b)``, those whose signatures do not rule out that the sets are similar enough."""
        ends = pairs.select(F.explode(F.array("a", "b")).alias("cid")).distinct()
        known = self.classes.select("cid", "n", "row").join(ends, "cid", "left_semi").join(self.signatures, "row").select("cid", "n", "signature")
        both = pairs.join(known.toDF("a", "a_n", "of_a"), "a").join(known.toDF("b", "b_n", "of_b"), "b")
        return written(both.mapInArrow(_pairs_allowed(self.percent), "a long, b long"), "possible")

    def _verified(self, pairs: DataFrame) -> DataFrame:
        """Of the class pairs ``(a, b)``, those whose sets are similar enough.

        A set leaves its document once; as the first of a pair it stays where it came to, as the second it goes on once a pair, to where the first is.
        """
        ends = pairs.select(F.explode(F.array("a", "b")).alias("cid")).distinct()
        wanted = self.classes.join(ends, "cid", "left_semi").select("cid", "doc_id", "set_hash")
        bits = self.spark.sparkContext.broadcast(_filter_bits(wanted))
        near = self.docs.select(F.pmod(F.xxhash64("doc_id"), F.lit(FILTER_BITS)).alias("bucket"), "text")
        sets = near.mapInArrow(_sets_of(self.width, bits), "set_hash binary, shingles array<long>")
        sets = sets.where("set_hash is not null").groupBy("set_hash").agg(F.any_value("shingles").alias("shingles"))
        names = wanted.select("cid", "set_hash")
        goes = pairs.join(names.toDF("a", "to"), "a").join(names.toDF("b", "set_hash"), "b")
        sent = sets.join(goes, "set_hash").select("to", "a", "b", F.col("shingles").alias("of_b"))
        both = sets.toDF("to", "of_a").join(sent, "to").withColumn("common", F.size(F.array_intersect("of_a", "of_b")))
        return both.where(F.col("common") * 100 >= (F.size("of_a") + F.size("of_b") - F.col("common")) * self.percent).select("a", "b")

    def _solve(self) -> None:
        led = self.listed.where((F.col("list") != F.col("gid")) & _fits(self.percent, "lead_n", "n"))
        star = led.join(self.classes.select("gid", "cid"), "gid").select(F.col("list").alias("a"), F.col("cid").alias("b"))
        inner = self.classes.where("cid <> gid").select(F.col("gid").alias("a"), F.col("cid").alias("b"))
        tried = written(star.union(inner).distinct(), "tried")
        links = written(self._verified(self._possible(tried)), "links")
        labels = self._labels(links)

        done = tried.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
        lists = None
        for forest in (True, False):
            classes = self.classes.join(labels.withColumnRenamed("node", "cid"), "cid", "left").withColumn("comp", F.coalesce("label", "cid"))
            rest = self._candidates(classes.select("gid", "cid", "n", "comp"), forest, lists)
            if forest:
                swept = written(rest, "swept")
                lists, rest = swept.where("a is null").select("list").distinct(), swept.where("a is not null").select("a", "b")
                if lists.isEmpty() and rest.isEmpty():
                    break
            rest = written(rest.join(done, ["a", "b"], "left_anti"), "rest")
            if not rest.isEmpty():
                links = written(links.union(self._verified(rest)), "links")
                labels = self._labels(links)
                done = done.union(rest)
        self._final = labels

    def _candidates(self, classes: DataFrame, forest: bool = False, lists: DataFrame | None = None) -> DataFrame:
        """Pairs ``(a, b)``, a < b, of classes ``(gid, cid, n, comp)`` of different components that share a list, less those that signatures rule out.

        With ``forest`` a cell gives only the closest that join the same components, and its list's name if that leaves pairs out.
        ``lists`` names the lists to look at, if not all.
        """
        rows = self.listed.select("list", "gid").join(classes, "gid")
        # a group of several classes is a list, too, the one that its head leads
        own = classes.join(classes.where("cid <> gid").select("gid").distinct(), "gid", "left_semi")
        rows = rows.select("list", "cid", "n", "comp").union(own.select("gid", "cid", "n", "comp")).distinct()
        if lists is not None:
            rows = rows.join(lists, "list", "left_semi")
        # the largest component of a long list meets the others, but not itself; a short list is one cell
        parts = rows.groupBy("list", "comp").agg(F.count("*").alias("size")).groupBy("list")
        parts = parts.agg(F.count("*").alias("comps"), F.max_by("comp", F.struct("size", "comp")).alias("main"), F.max("size").alias("most"), F.sum("size").alias("size"))
        short = F.col("size") <= BLOCK
        minor, major = (F.ceil(F.col(c) / BLOCK).cast("int") for c in ("others", "most"))
        parts = parts.where("comps > 1").withColumn("others", F.col("size") - F.col("most"))
        parts = parts.select("list", "main", short.alias("short"), F.when(short, 1).otherwise(minor).alias("minor"), F.when(short, 0).otherwise(major).alias("major"))
        rows = rows.join(parts, "list").withColumn("main", ~F.col("short") & (F.col("comp") == F.col("main")))
        rows = rows.withColumn("own", F.when(F.col("main"), F.col("minor") + F.pmod(F.hash("cid"), "major")).otherwise(F.pmod(F.hash("cid"), "minor")))
        rows = rows.withColumn("blocks", F.col("minor") + F.when(F.col("main"), 0).otherwise(F.col("major"))).select("list", "cid", "n", "comp", "own", "blocks")
        rows = written(rows, "rows")
        met = self.classes.select("cid", "row").join(rows.select("cid").distinct(), "cid", "left_semi")
        signatures = met.join(self.signatures, "row").select("cid", "signature")
        cells = rows.join(signatures, "cid").withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        cells = cells.select("list", F.least("own", "other").alias("lo"), F.greatest("own", "other").alias("hi"), "own", "cid", "n", "comp", "signature")
        cells = cells.repartition("list", "lo", "hi").sortWithinPartitions("list", "lo", "hi")
        return cells.mapInArrow(_allowed(self.percent, forest), "a long, b long" + ", list long" * forest).distinct()

    def _labels(self, links: DataFrame) -> DataFrame:
        return components(links)

    @cached_property
    def _pairs(self) -> DataFrame:
        """All verified class pairs ``(a, b)``, a < b."""
        candidates = self._candidates(self.classes.select("gid", "cid", "n", F.col("cid").alias("comp")))
        return written(self._verified(written(candidates, "met")), "all_links")

    def links(self) -> DataFrame:
        """Every link between classes, once, each class named by its smallest doc_id: doc_a, doc_b."""
        names = self.classes.select("cid", "doc_id")
        out = self._pairs.join(names.toDF("a", "doc_a"), "a").join(names.toDF("b", "doc_b"), "b")
        return out.select("doc_a", "doc_b")

    def link_counts(self) -> DataFrame:
        """doc_id, class_id (the smallest doc_id with the same set) and n_links, the number of other classes it is linked with, for every input row."""
        counts = self._pairs.select(F.explode(F.array("a", "b")).alias("cid")).groupBy("cid").agg(F.count("*").alias("n_links"))
        classes = self.classes.join(counts, "cid", "left").select("set_hash", F.col("doc_id").alias("class_id"), "n_links")
        rows = self.described.select("doc_id", "set_hash").join(classes, "set_hash", "left")
        alone = F.when(F.col("set_hash").isNull(), F.col("doc_id")).otherwise(F.col("class_id"))
        return rows.select("doc_id", alone.alias("class_id"), F.coalesce("n_links", F.lit(0)).alias("n_links"))

    def members(self) -> DataFrame:
        """doc_id, n_shingles, component_id for every input row."""
        classes = self.classes.join(self._final.withColumnRenamed("node", "cid"), "cid", "left").withColumn("comp", F.coalesce("label", "cid"))
        least = classes.groupBy("comp").agg(F.min("doc_id").alias("component_id"))
        named = classes.join(least, "comp").select("set_hash", "component_id")
        rows = self.described.select("doc_id", "n_shingles", "set_hash").join(named, "set_hash", "left")
        return rows.select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))


def one_of_each(docs: DataFrame, width: int = 5, percent: int = 75) -> DataFrame:
    """The documents without near copies: of each component the row with the smallest doc_id, all columns kept.

    Rows without shingles stay as they are, as do rows whose doc_id is null; of repeated rows with one doc_id one stays.
    """
    members = JaccardJoin(docs, width, percent).members()
    keep = members.where("n_shingles = 0 or doc_id = component_id").groupBy("doc_id").agg(F.max("n_shingles").alias("n")).withColumnRenamed("doc_id", "id")
    rows = docs.select(F.struct(*docs.columns).alias("row"), F.col("doc_id").alias("of")).join(keep, F.col("of") == F.col("id"), "left")
    rows = rows.where("id is not null or of is null")
    spot = Window.partitionBy("of").orderBy("row.text")
    rows = rows.withColumn("spot", F.row_number().over(spot)).where("spot = 1 or coalesce(n, 0) = 0")
    return rows.select("row.*")
