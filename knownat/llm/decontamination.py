"""Benchmark decontamination over a positional inverted index, in DataFrame operations only.

Words are ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` after lower-casing A-Z.  Occurrences of all test terms are counted over all documents;
each phrase is looked up by its two rarest terms.  The index stores a posting (term, document, position) for every occurrence of those
terms.  Shifting positions by a term's offset in the phrase turns its list into starts of the phrase; the two lists are intersected, and
what is left is compared word for word with the document.  Test terms are written before they are joined, so Spark knows their size and
broadcasts them only under its threshold; beyond that the same joins shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from knownat.llm.store import written

WINDOW = 10
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words(text: Column) -> Column:
    """The words of a text, in order; none for null."""
    plain = F.octet_length(text) == F.length(text)
    lowered = F.when(plain, F.lower(text)).otherwise(F.translate(text, _UPPER, _LOWER))
    return F.array_remove(F.split(F.coalesce(lowered, F.lit("")), _BETWEEN), "")


def windows(items: DataFrame, width: int = WINDOW) -> DataFrame:
    """Windows of ``width`` consecutive words of every item: item_id, terms.  A shorter item is one window, an item without words none."""
    split = items.select("item_id", words(F.col("text")).alias("w")).where("size(w) > 0")
    starts = F.sequence(F.lit(1), F.greatest(F.size("w") - width + 1, F.lit(1)))
    return split.select("item_id", "w", F.explode(starts).alias("s")).select("item_id", F.slice("w", F.col("s"), width).alias("terms"))


class PositionalIndex:
    """Looks up phrases in documents ``(doc_id, text)``; other columns are ignored.

    ``phrases`` has terms (array of words) and any number of columns beside them.  Null and empty texts have no words and no matches;
    repeated documents are found each on its own; a phrase that stands in several items, or several times in one, is looked up once.
    """

    def __init__(self, docs: DataFrame, phrases: DataFrame):
        self.docs = docs.select("doc_id", "text").withColumn("ref", F.xxhash64("doc_id", "text"))
        distinct = phrases.select("terms").where("size(terms) > 0").distinct()
        self.phrases = written(distinct.withColumn("phrase", F.monotonically_increasing_id()), "phrases")
        each = self.phrases.select("phrase", F.size("terms").alias("n"), F.posexplode("terms").alias("offset", "term"))
        terms = written(each.select("term").distinct(), "terms")
        found = self.docs.select(F.explode(words(F.col("text"))).alias("term")).join(terms, "term")
        counts = written(found.groupBy("term").agg(F.count("*").alias("count")), "term_counts")
        # a phrase with a term that no document holds cannot occur
        each = each.join(counts, "term", "left")
        rank = Window.partitionBy("phrase").orderBy(F.col("count").asc_nulls_first(), "term", "offset")
        ranked = each.withColumn("missing", F.max(F.col("count").isNull()).over(Window.partitionBy("phrase"))).withColumn("rank", F.row_number().over(rank))
        self.keys = written(ranked.where("not missing and rank <= 2").select("term", "phrase", "offset", "n"), "phrase_keys")
        self.postings = written(self._postings(self.keys.select("term").distinct()), "postings")

    def _postings(self, terms: DataFrame) -> DataFrame:
        at = self.docs.select("doc_id", "ref", F.posexplode(words(F.col("text"))).alias("pos", "term"))
        return at.join(terms, "term").select("term", "doc_id", "ref", "pos")

    def starts(self) -> DataFrame:
        """Where both rarest terms of a phrase agree: doc_id, ref, phrase, start."""
        moved = self.postings.join(self.keys, "term").select("doc_id", "ref", "phrase", (F.col("pos") - F.col("offset")).alias("start"), "offset", "n")
        agreed = moved.groupBy("doc_id", "ref", "phrase", "start").agg(F.min("offset").alias("a"), F.max("offset").alias("b"), F.max("n").alias("n"))
        return agreed.where("start >= 0 and (a <> b or n = 1)").select("doc_id", "ref", "phrase", "start")

    def matches(self) -> DataFrame:
        """Every row of the documents with its exact matches: doc_id, ref, n_words, hits (array of phrase, start, size)."""
        candidates = self.starts().join(self.phrases, "phrase").select(F.col("doc_id").alias("id"), F.col("ref").alias("of"), F.struct("phrase", "start", "terms").alias("c"))
        candidates = candidates.groupBy("id", "of").agg(F.collect_list("c").alias("cs"))
        rows = self.docs.join(candidates, self.docs["doc_id"].eqNullSafe(F.col("id")) & (self.docs["ref"] == F.col("of")), "left")
        rows = rows.select("doc_id", "ref", words(F.col("text")).alias("w"), F.coalesce("cs", F.array().cast(candidates.schema["cs"].dataType)).alias("cs"))
        same = F.filter("cs", lambda c: F.slice("w", c["start"] + 1, F.size(c["terms"])) == c["terms"])
        hits = F.transform(same, lambda c: F.struct(c["phrase"].alias("phrase"), c["start"].alias("start"), F.size(c["terms"]).alias("size")))
        return rows.select("doc_id", "ref", F.size("w").cast("long").alias("n_words"), hits.alias("hits"))

    def near(self, slack: int) -> DataFrame:
        """Proximity matches: all terms of a phrase, in any order, within its length plus ``slack`` words: doc_id, phrase, first (the rarest term's position)."""
        each = self.phrases.select("phrase", F.size("terms").alias("n"), F.explode(F.array_distinct("terms")).alias("term"))
        wanted = each.join(self.keys.select("phrase").distinct(), "phrase", "left_semi")
        lists = self._postings(wanted.select("term").distinct()).join(wanted, "term")
        lists = lists.groupBy("doc_id", "ref", "phrase", "n", "term").agg(F.array_sort(F.collect_set("pos")).alias("at"))
        shortest = F.min(F.struct(F.size("at").alias("k"), "term", "at"))
        per_doc = lists.groupBy("doc_id", "ref", "phrase", "n").agg(F.count("*").alias("terms"), F.collect_list("at").alias("lists"), shortest.alias("key"))
        full = per_doc.join(self.phrases.select("phrase", F.size(F.array_distinct("terms")).alias("want")), "phrase").where("terms = want")
        span = F.col("n") + slack
        at = full.select("doc_id", "phrase", "lists", span.alias("span"), F.explode("key.at").alias("first"))
        inside = F.exists(
            F.sequence(F.col("first") - F.col("span") + 1, F.col("first")),
            lambda s: F.forall("lists", lambda one: F.exists(one, lambda p: (p >= s) & (p < s + F.col("span")))),
        )
        return at.where(inside).select("doc_id", "phrase", "first")


def contamination(docs: DataFrame, items: DataFrame, width: int = WINDOW) -> DataFrame:
    """How much of each document stands in the test items: doc_id, n_words, n_hit, items (sorted ids as strings), contaminated.

    A document word inside any occurrence of a window of ``width`` item words (or of a whole shorter item) is hit.  Takes ``(doc_id, text)`` and
    ``(item_id, text)``; null and empty texts have no words, an item without id is matched but not named, repeated rows give repeated rows.
    """
    cut = windows(items, width)
    index = PositionalIndex(docs, cut)
    positions = F.flatten(F.transform("hits", lambda h: F.sequence(h["start"], h["start"] + h["size"] - 1)))
    found = index.matches().select(
        "doc_id", "ref", "n_words", F.size(F.array_distinct(positions)).cast("long").alias("n_hit"), F.array_distinct(F.transform("hits", lambda h: h["phrase"])).alias("phrases"),
    )
    found = written(found, "matches")
    named = cut.distinct().join(index.phrases, "terms").select("phrase", F.col("item_id").cast("string").alias("item"))
    items_of = found.where("n_hit > 0").select("doc_id", "ref", F.explode("phrases").alias("phrase")).join(named, "phrase")
    items_of = items_of.groupBy(F.col("doc_id").alias("id"), F.col("ref").alias("of")).agg(F.array_sort(F.collect_set("item")).alias("items"))
    rows = found.join(items_of, found["doc_id"].eqNullSafe(F.col("id")) & (found["ref"] == F.col("of")), "left")
    return rows.select("doc_id", "n_words", "n_hit", F.coalesce("items", F.array().cast("array<string>")).alias("items"), (F.col("n_hit") > 0).alias("contaminated"))


def without_items(docs: DataFrame, items: DataFrame, width: int = WINDOW) -> DataFrame:
    """The documents in which no window of an item occurs, all columns kept; rows without text are clean."""
    dirty = contamination(docs, items, width).where("contaminated").select(F.col("doc_id").alias("id")).distinct()
    rows = docs.select(F.struct(*docs.columns).alias("row"), F.col("doc_id").alias("of"))
    return rows.join(dirty, F.col("of").eqNullSafe(F.col("id")), "left_anti").select("row.*")
