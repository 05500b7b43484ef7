"""Registered names in texts: where they occur, which longer names swallow them, and what that says about the company.

Everything is a table.  A text becomes two sequences of equal length: its characters without the white space a name may be written with, and
for each of them whether white space stood before it.  The first few characters of every registered spelling are its key.  Every position of a
text is looked up in a bitmap of these keys, whole arrays at a time; the few that may begin a spelling become rows, which meet the spellings in
an equi-join, and the rest of a spelling is compared with the characters that follow.  An occurrence is a (text, spelling, start, end) row:
swallowing is interval containment within a text, and verdicts are aggregates over a (text, instrument).  The registry is a join side of any
size, the bitmap has a fixed one; a text may have any length.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from functools import cache, reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window as W, functions as F, types as T

from knownat.session import shared_folder

# Fixed values of the relevance rule.
CONTEXT_WORDS = (
    "실적", "매출", "영업이익", "순이익", "수주", "공시", "주가", "주식", "대표이사", "상장", "코스피", "코스닥", "투자", "계약", "배당",
)
SINGLE_PARTICLES = "은는이가의을를와과도에로"
LEAD_PARTICLES = "은는이가"
LONG_PARTICLES = (
    "에서", "으로", "에게", "까지", "부터", "보다", "처럼", "과의", "와의", "에는", "에도", "이다", "이며", "이고", "이나", "만의",
)
#: Names of at most so many letters need word edges (Hangul), exact case (Latin) and evidence that a company is meant.
SHORT = 3
HANGUL = "가-힣ᄀ-ᇿ㄰-㆏"
_MARK_BEFORE, _MARK_AFTER = r"(\(주\)|㈜)$", r"^(\(주\)|㈜)"
_WORD_END = f"^((?:{'|'.join(LONG_PARTICLES)}|[{SINGLE_PARTICLES}])?)(?![{HANGUL}])"
_TITLE_OPENING = r"""^(?:\s*(?:\[[^\]]*\]|<[^>]*>|【[^】]*】|\([^)]*\))\s*)*[ "'“‘]*"""

_SPACES = r"(?U)\s+"
#: White space a spelling may skip, white space it may not, and the flag of a character that had the former before it.
_SOFT, _HARD, _FLAG = "\u0001", "\u0002", "\u0003"
#: Characters of a text looked at before and after an occurrence.
_BEFORE, _AFTER = 3, 3
#: Positions of a text that are looked up together, and places that leave a task as one batch.
_CUTS = (1 << 18, 1 << 13)
#: Characters of a spelling that are its join key; shorter spellings are keyed whole.
_KEY = 3
#: Bits of the filter on keys; false positives cost time, not results.
_FILTER_BITS = 1 << 24


def squeezed(text: Column) -> Column:
    return F.regexp_replace(text, _SPACES, "")


def _letters(text: Column) -> tuple[Column, Column]:
    """Characters without the white space that names may skip, which is any but that between two Hangul letters; and its flags."""
    plain = F.translate(F.coalesce(text, F.lit("")), _SOFT + _HARD + _FLAG + "\x1c\x1d\x1e\x1f", "???    ")
    marked = F.regexp_replace(F.regexp_replace(plain, _SPACES, _SOFT), f"{_SOFT}$", "")
    marked = F.regexp_replace(marked, f"(?<=[{HANGUL}]){_SOFT}(?=[{HANGUL}])", _HARD)
    flags = F.regexp_replace(F.regexp_replace(marked, f"{_SOFT}[^{_SOFT}]", _FLAG), f"[^{_FLAG}]", "0")
    return F.translate(marked, _SOFT, ""), flags


def spellings(registry: DataFrame) -> DataFrame:
    """One row per instrument and way to name it: instrument_id, kind (NAME, ALIAS, SYMBOL), spelled, flat, exact, flat, size, latin, hangul."""
    one = lambda kind, column: F.struct(F.lit(kind).alias("kind"), column.alias("spelled"))
    aliases = F.transform(F.coalesce(F.col("aliases"), F.array().cast("array<string>")), lambda a: one("ALIAS", a))
    ways = registry.select("instrument_id", F.explode(F.concat(F.array(one("NAME", F.col("name"))), aliases, F.array(one("SYMBOL", F.col("symbol"))))).alias("_w"))
    exact = F.when(F.col("_w.kind") == "SYMBOL", F.col("_w.spelled")).otherwise(squeezed(F.col("_w.spelled")))
    out = ways.select("instrument_id", F.col("_w.kind").alias("kind"), F.col("_w.spelled").alias("spelled"), exact.alias("exact"))
    flat = F.when(F.col("kind") == "SYMBOL", F.col("exact")).otherwise(F.lower("exact"))
    return out.where(F.length("exact") > 0).select(
        "*", flat.alias("flat"), F.length("exact").alias("size"), F.col("exact").rlike("^[A-Za-z0-9]+$").alias("latin"), F.col("exact").rlike(f"^[{HANGUL}]+$").alias("hangul"))


@cache
def _characters() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of the first 65,536 code points: white space, Hangul, and the lower-case letter; 0 where lower-casing is not letter by letter."""
    space, hangul, lower = np.zeros(1 << 16, bool), np.zeros(1 << 16, bool), np.arange(1 << 16, dtype=np.uint64)
    space[[*range(0x09, 0x0E), *range(0x1C, 0x21), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]] = True
    for first, last in HANGUL.replace("-", "")[:2], HANGUL.replace("-", "")[2:4], HANGUL.replace("-", "")[4:]:
        hangul[ord(first) : ord(last) + 1] = True
    for c in range(1 << 16):
        low = chr(c).lower()
        lower[c] = ord(low) if len(low) == 1 and low != "σ" else 0
    lower[0xFFFF] = 0  # stands for all that lie above
    return space, hangul, lower


def _lettered(text: str) -> tuple[np.ndarray, np.ndarray]:
    """What :func:`_letters` says, as code points and whether each had white space before it."""
    space, hangul, _ = _characters()
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")
    codes = np.where((codes > 0) & (codes <= 3), ord("?"), codes)
    spot = np.minimum(codes, 0xFFFF)
    gap = space[spot]
    edge = np.diff(gap.astype(np.int8), prepend=0, append=0)
    first, last = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1) - 1
    inner = (first > 0) & (last < len(codes) - 1)
    hard = first[inner][hangul[spot[first[inner] - 1]] & hangul[spot[last[inner] + 1]]]
    kept = ~gap
    flagged = kept.copy()
    flagged[1:] &= gap[:-1]
    flagged[:1] = False
    flagged[last[np.isin(first, hard)] + 1] = False
    kept[hard] = True
    codes[hard] = ord(_HARD)
    return codes[kept], flagged[kept]


def _spots(low: Sequence[np.ndarray]) -> np.ndarray:
    """Places in the filter of keys whose lower-cased letters are given one array a letter."""
    key = np.zeros(len(low[0]), np.uint64)
    for k, letters in enumerate(low):
        key |= letters.astype(np.uint64) << np.uint64(21 * k)
    key = (key ^ (key >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    key = (key ^ (key >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return ((key ^ (key >> np.uint64(31))) & np.uint64(_FILTER_BITS - 1)).astype(np.int64)


def _key_bits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Bytes of the filter with the bits of keys; keys with letters that are not lower-cased one by one are never looked up."""
    lower = _characters()[2]
    for batch in batches:
        spots = []
        for key in batch.column("_key").to_pylist():
            low = [int(lower[min(ord(c), 0xFFFF)]) for c in key]
            if all(low) and len(low) <= _KEY:
                spots.append(int(_spots([np.array([c]) for c in low])[0]))
        yield pa.RecordBatch.from_arrays([pa.array([s >> 3 for s in spots], pa.int32()), pa.array([1 << (s & 7) for s in spots], pa.int32())], ["byte", "bits"])


def _filter(keys: DataFrame) -> bytes:
    """A bitmap of the column ``_key``, built by or-ing bytes in Spark; its size is fixed."""
    rows = keys.select("_key").distinct().mapInArrow(_key_bits, "byte int, bits int").groupBy("byte").agg(F.expr("bit_or(bits)").alias("bits")).toArrow()
    out = np.zeros(_FILTER_BITS // 8, np.uint8)  # at most so many rows
    out[rows["byte"].to_numpy()] = rows["bits"].to_numpy()
    return out.tobytes()


def _places(keep: Sequence[str], keys: Sequence[int], after: int, bits, cuts: tuple[int, int]):
    """Per text and key length, the places at which a spelling may begin: ``keep``, size of the key, start, letters and flags around it."""
    some, many = cuts
    wide = _BEFORE + after

    def wanted(codes: np.ndarray, first: int) -> list[np.ndarray]:
        """Places from ``first`` on, one array per key length."""
        lower, held = _characters()[2], np.frombuffer(bits.value, np.uint8)
        spot = np.minimum(codes[first : first + some + _KEY - 1], 0xFFFF)
        low = np.append(lower[spot], np.full(_KEY, ord(" "), np.uint64))
        count = min(some, len(codes) - first)
        out = []
        for size in keys:
            letters = [low[k : k + count] for k in range(size)]
            at = _spots(letters)
            hit = (held[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1
            out.append(first + np.flatnonzero(reduce(np.logical_or, [c == 0 for c in letters], hit)))
        return out

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[int] = []
            columns: list[list] = [[], [], [], []]

            def flush():
                left = [batch.column(c).take(pa.array(rows, pa.int64())) for c in keep]
                kinds = (pa.int32(), pa.int64(), pa.string(), pa.string())
                out = pa.RecordBatch.from_arrays([*left, *(pa.array(c, k) for c, k in zip(columns, kinds))], [*keep, "_size", "start", "_letters", "_flags"])
                for column in (rows, *columns):
                    column.clear()
                return out

            for row, raw in enumerate(batch.column("text").cast(pa.binary()).to_pylist()):
                codes, flagged = _lettered((raw or b"").decode("utf-8", "replace"))
                letters = " " * _BEFORE + codes.tobytes().decode("utf-32-le", "surrogatepass") + " " * after
                flags = "0" * _BEFORE + np.where(flagged, ord(_FLAG), ord("0")).astype(np.uint8).tobytes().decode("ascii") + "0" * after
                for first in range(0, len(codes), some):
                    for size, found in zip(keys, wanted(codes, first)):
                        for lo in range(0, len(found), many):
                            at = found[lo : lo + many].tolist()
                            for column, values in zip((rows, *columns), ([row] * len(at), [size] * len(at), at, [letters[i : i + wide] for i in at], [flags[i : i + wide] for i in at])):
                                column.extend(values)
                            if len(rows) >= many:
                                yield flush()
            if rows:
                yield flush()

    return find


@dataclass(frozen=True)
class _Facts:
    """What is small about a registry: sizes of its spellings in letters."""

    sizes: tuple[int, ...]

    @property
    def longest(self) -> int:
        return max(self.sizes, default=0)

    @property
    def keys(self) -> list[int]:
        return sorted({min(n, _KEY) for n in self.sizes})


def _facts(terms: DataFrame) -> _Facts:
    return _Facts(tuple(sorted(terms.agg(F.collect_set("size")).first()[0])))


def _stored(terms: DataFrame) -> DataFrame:
    """The spellings written once to the shared folder: their size is then known, and Spark ships them to the texts' tasks only if it is small."""
    path = f"{shared_folder(terms.sparkSession)}/spellings-{uuid.uuid4().hex}"
    terms.write.parquet(path)
    return terms.sparkSession.read.schema(terms.schema).parquet(path)


def occurrences(texts: DataFrame, terms: DataFrame, keep: Sequence[str] = (), facts: _Facts | None = None, skip=None) -> DataFrame:
    """Every place where a spelling stands in a text.

    ``texts`` has ``text`` and any other columns, of which ``keep`` are kept; ``terms`` is made by :func:`spellings`.  Adds the term's columns,
    ``start`` and ``end`` in letters, ``written`` (the letters as written), ``head`` and ``tail`` (what stands before and after, white space
    included, up to three characters).  Names may be written with white space wherever not two Hangul letters meet, in any case; symbols stand
    exactly.  Null texts are empty.  ``skip(term, gap, before, after)`` names places that are not wanted, by the term's struct, whether white
    space stands before, and the letters before and after.
    """
    facts = facts or _facts(terms)
    keys, after = facts.keys, facts.longest + _AFTER
    lowered = F.lower(F.substring("flat", 1, _KEY)).alias("_key")
    bits = terms.sparkSession.sparkContext.broadcast(_filter(terms.select(lowered)))
    fields = [*texts.select(*keep).schema.fields, *T._parse_datatype_string("_size int, start long, _letters string, _flags string").fields]
    rows = texts.select(*keep, "text").mapInArrow(_places(list(keep), keys, after, bits, _CUTS), T.StructType(fields))
    named = rows.select(*keep, "start", F.lower(F.col("_letters").substr(F.lit(_BEFORE + 1), F.col("_size"))).alias("_key"), "_letters", "_flags")
    # a term travels as one struct and unneeded places go at once: the code of the loop over positions has to stay small to be compiled
    coded = terms.select(lowered, F.lower("flat").alias("_low"), "size", F.struct(*terms.columns).alias("_t"))
    size = F.col("size")
    written = F.col("_letters").substr(F.lit(_BEFORE + 1), size)
    same = F.lower(written) == F.col("_low")
    if skip is not None:
        place = F.lit(_BEFORE + 1)
        same = same & ~skip(F.col("_t"), F.col("_flags").substr(place, F.lit(1)) == _FLAG, F.col("_letters").substr(place - 1, F.lit(1)), F.col("_letters").substr(place + size, F.lit(1)))
    found = named.join(coded, "_key").where(same)

    def around(place: Column, count: int, gap_last: bool) -> Column:
        """``count`` characters from ``place`` on, white space put back before each (and after the last one)."""
        out = []
        for k in range(count + gap_last):
            out.append(F.when(F.col("_flags").substr(place + k, F.lit(1)) == _FLAG, " ").otherwise(""))
            out += [F.col("_letters").substr(place + k, F.lit(1))] if k < count else []
        gaps = F.col("_flags").substr(place, F.lit(count + gap_last)).contains(_FLAG)
        return F.translate(F.when(gaps, F.concat(*out)).otherwise(F.col("_letters").substr(place, F.lit(count))), _HARD, " ")

    # a symbol is text as it stands: exact, and no white space inside
    broken = F.col("_flags").substr(F.lit(_BEFORE + 2), size - 1).contains(_FLAG)
    exact = (F.col("_t.kind") != "SYMBOL") | ((written == F.col("_t.exact")) & ~broken)
    fields = F.struct(
        written.alias("written"), exact.alias("_exact"), around(F.lit(1), _BEFORE, True).alias("head"), around(F.lit(_BEFORE + 1) + size, _AFTER, False).alias("tail"))
    out = found.select(*keep, "_t", "start", (F.col("start") + size).alias("end"), _once(fields)).where("_once._exact")
    return out.select(*keep, "_t.*", "start", "end", "_once.written", "_once.head", "_once.tail")


def _once(fields: Column) -> Column:
    """A struct worked out once a row, outside the generated code of the rows before, which stays small enough to be compiled."""
    return F.explode(F.transform(F.array(F.lit(0)), lambda _: fields)).alias("_once")


def conflicts(registry: DataFrame) -> DataFrame:
    """Longer registered spellings, names or aliases, that contain one of an instrument's own: instrument_id, name (the one contained), other.

    Every shorter piece of a spelling, of the sizes that are registered, is a join key, so no pair of spellings is ever compared.
    """
    ways = spellings(registry).where("kind <> 'SYMBOL'")
    # both sides are distinct before they meet, and a name has one piece, so what they make, many times their rows, is distinct as it is
    others = ways.select(F.col("spelled").alias("other"), "flat").distinct().join(_contained(ways, _facts(ways)), "flat").select("_piece", "other").distinct()
    own = ways.select("instrument_id", F.col("spelled").alias("name"), F.col("flat").alias("_piece")).distinct()
    return own.join(others, "_piece").select("instrument_id", "name", "other")


def _contained(ways: DataFrame, facts: _Facts) -> DataFrame:
    """Spellings and the shorter spellings inside them: flat, _piece."""
    flats = ways.select("flat", "size").distinct()
    shorter = F.filter(F.array(*map(F.lit, facts.sizes)).cast("array<int>"), lambda n: n < F.col("size"))
    pieces = F.flatten(F.transform(shorter, lambda n: F.transform(F.sequence(F.lit(1), F.col("size") - n + 1), lambda i: F.substring(F.col("flat"), i, n))))
    cut = flats.select("flat", F.explode(F.array_distinct(pieces)).alias("_piece"))
    return cut.join(flats.select(F.col("flat").alias("_piece")), "_piece", "left_semi")


def _swallowed(found: DataFrame, key: Sequence[str]) -> DataFrame:
    """Adds whether a name or alias lies inside a longer one of the same text."""
    at = W.partitionBy(*key).orderBy("start")
    # occurrences that begin before it reach at least as far, or one that begins with it reaches further
    reach = F.max(F.when(F.col("kind") != "SYMBOL", F.col("end")))
    before = reach.over(at.rangeBetween(W.unboundedPreceding, -1)) >= F.col("end")
    beside = reach.over(at.rangeBetween(W.currentRow, W.currentRow)) > F.col("end")
    inside = F.coalesce(before, F.lit(False)) | F.coalesce(beside, F.lit(False))
    return found.withColumn("swallowed", (F.col("kind") != "SYMBOL") & inside)


def judged(texts: DataFrame, registry: DataFrame, key: Sequence[str]) -> DataFrame:
    """Verdict of every (text, instrument) in which something of the instrument counts: ``key``, instrument_id, decision, match_method, decision_reason.

    ``texts``: key columns that tell texts apart, title, summary.  ``registry``: instrument_id, name, aliases, symbol.  What is not among the
    rows, or is REJECTED with reason ``absent``, is not named.  Decisions: CONFIRMED, PENDING (for a model), REJECTED; names before aliases
    before symbols.
    """
    title = F.coalesce(F.col("title"), F.lit(""))
    text = F.concat(title, F.lit(" "), F.coalesce(F.col("summary"), F.lit("")))
    mask = reduce(lambda a, b: a + b, [F.when(text.contains(w), 1 << k).otherwise(0) for k, w in enumerate(CONTEXT_WORDS)])
    opened = F.regexp_replace(title, _TITLE_OPENING, "")
    ends = F.length(_letters(title)[0])
    told = texts.select(*key, text.alias("text"), mask.alias("context"), ends.alias("title_end"), (ends - F.length(_letters(opened)[0])).alias("title_start"))
    terms = spellings(registry)
    facts = _facts(terms)
    covering = _contained(terms.where("kind <> 'SYMBOL'"), facts).select("flat", F.lit(True).alias("_covers")).distinct()
    terms = terms.join(covering, "flat", "left").withColumn("covers", F.coalesce("_covers", F.lit(False)) & (F.col("kind") != "SYMBOL")).drop("_covers")

    def inside_latin(term: Column, gap: Column, before: Column, after: Column) -> Column:
        """A Latin spelling within a word, which swallows nothing and has no corporate mark, tells nothing."""
        return term["latin"] & ~term["covers"] & (term["kind"] != "SYMBOL") & ~gap & before.rlike("[A-Za-z0-9]") & ~after.isin("(", "㈜")

    found = occurrences(told, _stored(terms), [*key, "context", "title_start", "title_end"], facts, inside_latin)

    name, latin = F.col("kind") == "NAME", F.col("latin")
    head, tail, size = F.col("head"), F.col("tail"), F.col("size")
    alone = F.when(F.col("kind") == "SYMBOL", ~head.rlike("[0-9]$") & ~tail.rlike("^[0-9]")).when(
        latin, ~head.rlike(f"[A-Za-z0-9{HANGUL}]$") & ~tail.rlike("^[A-Za-z0-9]") & ((size > SHORT) | (F.col("written") == F.col("exact")))).otherwise(F.lit(True))
    starts, ends_word = ~head.rlike(f"[{HANGUL}]$"), tail.rlike(_WORD_END)
    comma = tail.rlike(r"^\s*,") & (F.col("end") < F.col("title_end"))
    subject = tail.rlike(f"^[{LEAD_PARTICLES}](?![{HANGUL}])") & (F.col("end") < F.col("title_end"))
    lead = name & (F.col("start") == F.col("title_start")) & (comma | subject)
    mark = name & ((head.rlike(_MARK_BEFORE) & ends_word) | (starts & tail.rlike(_MARK_AFTER)))
    kept = ("instrument_id", "kind", "size", "latin", "hangul", "context", "start", "end", "covers")
    flags = F.struct(alone.alias("alone"), starts.alias("starts"), (starts & ends_word).alias("whole"), lead.alias("lead"), mark.alias("mark"))
    told = found.select(*key, *kept, _once(flags)).select(*key, *kept, "_once.*").where("alone OR covers OR lead OR mark")
    held = _swallowed(told, key)
    free = F.col("alone") & ~F.col("swallowed")
    any_ = lambda kind, *more: F.bool_or((F.col("kind") == kind) & free & reduce(lambda a, b: a & b, more, F.lit(True)))
    facts = held.groupBy(*key, "instrument_id").agg(
        any_("NAME").alias("named"), any_("ALIAS").alias("by_alias"), any_("SYMBOL").alias("by_symbol"), any_("NAME", F.col("starts")).alias("as_word"),
        any_("NAME", F.col("whole")).alias("as_whole"), F.bool_or("lead").alias("lead"), F.bool_or("mark").alias("mark"), F.max("context").alias("context"),
        *[F.max(F.when(F.col("kind") == "NAME", F.col(c))).alias(c) for c in ("size", "latin", "hangul")])
    return facts.select(*key, "instrument_id", *_verdict())


def _verdict() -> list[Column]:
    """Decision, method and reason from what is known of a name in a text."""
    short = F.coalesce(F.col("size") <= SHORT, F.lit(False))
    bounded = short & F.coalesce("hangul", F.lit(False))
    inside = F.col("named") & bounded & ~F.col("as_word")
    method = F.when(F.col("named") & ~inside, "NAME").when(F.col("by_alias"), "ALIAS").when(F.col("by_symbol"), "SYMBOL")
    words = [F.when(F.col("context").bitwiseAND(1 << k) > 0, w) for k, w in enumerate(CONTEXT_WORDS)]
    weak = F.array_compact(F.array(*words))
    compound = bounded & ~F.col("as_whole")
    needs = (short & F.coalesce("latin", F.lit(False))) | (bounded & (F.col("size") >= 2))
    enough = F.size(weak) >= F.when(F.col("size") <= 2, 2).otherwise(1)
    strong = F.when(F.col("by_symbol"), "strong:symbol").when(F.col("lead"), "strong:title_lead").when(F.col("mark"), "strong:corporate_mark")
    # (condition, decision, reason) in order
    rules = [
        (method.isNull(), "REJECTED", F.when(inside, "absent:inside_word").otherwise("absent")),
        (method == "SYMBOL", "CONFIRMED", F.lit("strong:symbol")),
        (method == "ALIAS", "CONFIRMED", F.lit("alias")),
        (compound, "PENDING", F.lit("context:compound")),
        (~needs, "CONFIRMED", F.lit("name")),
        (strong.isNotNull(), "CONFIRMED", strong),
        (enough, "CONFIRMED", F.concat(F.lit("weak:"), F.array_join(F.slice(weak, 1, 3), "+"))),
        (F.lit(True), "PENDING", F.concat(F.lit("context:"), F.coalesce(F.try_element_at(weak, F.lit(1)), F.lit("none")))),
    ]
    decision, reason = F.lit(None).cast("string"), F.lit(None).cast("string")
    for condition, verdict, why in reversed(rules):
        decision, reason = F.when(condition, verdict).otherwise(decision), F.when(condition, why).otherwise(reason)
    return [decision.alias("decision"), method.alias("match_method"), reason.alias("decision_reason")]


def rejudged(hits: DataFrame, registry: DataFrame, rule_version: int) -> DataFrame:
    """Judges every stored hit of an older rule again, on the title and snippet it read: one row per hit.

    ``hits``: hit_id, instrument_id, title, snippet, decision, rule_version, decided_by.  Hits decided by a model or under ``rule_version`` are
    not stale.  ``outcome`` is JUDGED, UNREAD (no snippet was stored) or SKIPPED (the instrument is no longer registered); only JUDGED rows have
    a new decision, ``absent`` where nothing of the instrument is in the text.  ``changed`` tells that the decision differs.
    """
    stale = hits.where((F.col("decided_by") == "RULE") & (F.col("rule_version") < rule_version))
    texts = stale.where("snippet IS NOT NULL").select("hit_id", "title", F.col("snippet").alias("summary")).dropDuplicates(["hit_id"])
    fresh = judged(texts, registry, ["hit_id"]).select(
        "hit_id", "instrument_id", F.col("decision").alias("new_decision"), F.col("match_method").alias("new_method"), F.col("decision_reason").alias("new_reason"))
    known = registry.select("instrument_id", F.lit(True).alias("_known")).distinct()
    rows = stale.select("hit_id", "instrument_id", F.col("decision").alias("old_decision"), F.col("snippet").isNotNull().alias("_read"))
    rows = rows.join(known, "instrument_id", "left").join(fresh, ["hit_id", "instrument_id"], "left")
    outcome = F.when(~F.col("_read"), "UNREAD").when(F.col("_known").isNull(), "SKIPPED").otherwise("JUDGED")
    judged_now = outcome == "JUDGED"
    decision = F.when(judged_now, F.coalesce("new_decision", F.lit("REJECTED")))
    return rows.select(
        "hit_id", "instrument_id", outcome.alias("outcome"), decision.alias("decision"), F.when(judged_now, F.col("new_method")).alias("match_method"),
        F.when(judged_now, F.coalesce("new_reason", F.lit("absent"))).alias("decision_reason"), "old_decision",
        F.coalesce(decision != F.col("old_decision"), F.lit(False)).alias("changed"))
