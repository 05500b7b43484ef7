"""Language of texts by compression.

Each language is a zstandard raw-content dictionary of its lower-cased training texts.  A lower-cased text is cut into blocks of ``BLOCK`` bytes, every block is
encoded with every dictionary, and the language with the fewest bytes in all is chosen.  Where the runner-up needs less than ``MARGIN`` more
the choice is marked as rejected.  Dictionaries hold ``DICTIONARY`` bytes at most, of pieces that begin at hashed
places of ``SAMPLE`` texts a language; all these texts are in it, with equal shares but for those that are shorter.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import regex
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from knownat.llm.text import slices

#: Texts and bytes a dictionary is made of at most.
SAMPLE = 400
DICTIONARY = 96 << 10
#: Parts a language's rows are first thinned in.
SLICES = 64
BLOCK = 1 << 11
LEVEL = 3
#: Share of the smallest size by which the runner-up must be larger.
MARGIN = 0.01
UNKNOWN = "und"
_LETTER = regex.compile(r"\p{L}")


def learn(docs: DataFrame, use: Column, sample: int = SAMPLE, size: int = DICTIONARY) -> list[tuple[str, bytes]]:
    """Dictionaries (language, content), the language with most training rows first; learns from rows with a language, a text and ``use``.

    One row per language and pieces of ``sample`` texts of each, up to four times their share of the dictionary, reach the driver.
    """
    rows = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & use)
    counts = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().collect()}
    order = Window.partitionBy("lang").orderBy(F.xxhash64("doc_id", "text"))
    each = max(1, 4 * size // sample)
    picked = rows.where("text rlike '[^\\\\s]'").select("doc_id", "lang", "text")
    # a language may hold a third of all rows: each of its SLICES gives at most ``sample`` rows to the task that orders the language
    sliced = Window.partitionBy("lang", F.pmod(F.xxhash64("text"), F.lit(SLICES))).orderBy(F.xxhash64("doc_id", "text"))
    picked = picked.withColumn("n", F.row_number().over(sliced)).where(F.col("n") <= sample)
    picked = picked.withColumn("n", F.row_number().over(order)).where(F.col("n") <= sample)
    found: dict[str, list[bytes]] = {lang: [] for lang in counts}
    begin = F.pmod(F.xxhash64("text", "doc_id"), F.greatest(F.length("text") - size // sample, F.lit(0)) + 1).cast("int") + 1
    for r in picked.select("lang", "n", F.col("text").substr(begin, F.lit(each)).alias("text")).orderBy("lang", "n").collect():
        found[r["lang"]].append(r["text"].lower().encode())
    ranked = sorted(counts, key=lambda lang: (-counts[lang], lang))
    return [(lang, filled(found[lang], size).ljust(8, b"\n")) for lang in ranked]


def filled(pieces: list[bytes], size: int) -> bytes:
    """At most ``size`` bytes of all pieces, a line each: as many bytes of every piece, and what shorter ones leave goes to the longer ones."""
    left, share = size, 0
    for k, n in enumerate(sorted(map(len, pieces))):
        share = left // (len(pieces) - k) - 1  # a line's end
        if n > share:
            break
        left -= n + 1
        share = n
    return b"\n".join(p[: max(0, share)] for p in pieces)[:size]


def _classify(dictionaries):
    def classify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coders = []
        for _, content in dictionaries.value:
            d = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            d.precompute_compress(level=LEVEL)
            coders.append(zstandard.ZstdCompressor(dict_data=d, write_checksum=False, write_content_size=False, write_dict_id=False).compress)
        names = [lang for lang, _ in dictionaries.value]
        empty = [len(c(b"")) for c in coders]
        for batch in batches:
            for part in slices(batch, "text"):
                pred, score, margin, rejected = [], [], [], []
                for text in part.column("text").to_pylist():
                    if not names or text is None or not _LETTER.search(text):
                        for column, value in zip((pred, score, margin, rejected), (UNKNOWN, 0.0, 0.0, True)):
                            column.append(value)
                        continue
                    data = text.lower().encode("utf-8", "surrogatepass")
                    blocks = [data[i : i + BLOCK] for i in range(0, len(data), BLOCK)]
                    sizes = [sum(map(len, map(c, blocks))) - e * len(blocks) for c, e in zip(coders, empty)]
                    best = min(range(len(sizes)), key=sizes.__getitem__)  # ties: the language with more training rows
                    rest = min((s for i, s in enumerate(sizes) if i != best), default=2 * sizes[best] + 1)
                    lead = (rest - sizes[best]) / max(1, sizes[best])
                    pred.append(names[best])
                    score.append(1 / sum(2.0 ** -min(60.0, (s - sizes[best]) / 2) for s in sizes))
                    margin.append(lead)
                    rejected.append(lead < MARGIN)
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), pa.array(pred, pa.string()), pa.array(score, pa.float64()), pa.array(margin, pa.float64()), pa.array(rejected, pa.bool_())],
                    ["doc_id", "lang_pred", "score", "margin", "rejected"],
                )

    return classify


def language(docs: DataFrame, dictionaries: list[tuple[str, bytes]]) -> DataFrame:
    """``(doc_id, text)`` to (doc_id, lang_pred, score, margin, rejected), one row per input row; other columns are ignored.

    Null texts and texts without a letter are ``und`` with score 0; a choice within ``MARGIN`` stands in lang_pred and is marked rejected;
    equal sizes go to the language with more training rows; without dictionaries every text is ``und``; an empty table gives an empty result.
    """
    shared = docs.sparkSession.sparkContext.broadcast(dictionaries)
    kind = "doc_id long, lang_pred string, score double, margin double, rejected boolean"
    return docs.select("doc_id", "text").mapInArrow(_classify(shared), kind)
