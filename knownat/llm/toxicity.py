"""Toxicity of texts by subword-bag embeddings.

A word is the mean of the embeddings of its character n-grams, hashed into ``BUCKETS`` rows, so a misspelling keeps most of its vector.  A
passage is any ``PASSAGE`` words in a row (all words of a shorter text) and the mean of its words; a linear softmax over two classes reads it.  Embeddings and softmax are trained
jointly: first on whole-text means, then on each text's most toxic passage, which is also what a score is, so a few insults in a very long
text are not averaged away.  Training sees a bounded sample of ``SAMPLE`` labelled texts; scoring sees every whole text.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from knownat.llm.text import slices

#: Labelled texts, chosen by a hash of their id, that a model is fitted on at most.
SAMPLE = 6000
BUCKETS = 1 << 15
DIM = 8
PASSAGE = 12
RATE = 0.3
#: Where the squared gradients of an embedding start: the larger, the less a rare n-gram learns from one text.
DAMPING = 1e-3
#: Epochs over whole texts; then rounds that pick each text's most toxic passage, and epochs over the picked ones.
WHOLE = 2
ROUNDS = 10
INNER = 2
THRESHOLD = 0.3
#: Words whose scores a task remembers.
REMEMBERED = 400_000
_WORD = re.compile(r"\w+")


def subwords(word: str) -> list[int]:
    """Buckets of the character 3- to 5-grams of ``<word>`` and of the whole."""
    marked = f"<{word}>"
    grams = [marked[i : i + n] for n in (3, 4, 5) for i in range(len(marked) - n + 1)]
    return [zlib.crc32(g.encode("utf-8", "surrogatepass")) % BUCKETS for g in (*grams, marked)]


def _bags(words: Iterable[str]) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of all words end to end, and the n + 1 places where words begin and end."""
    each = [np.array(subwords(w), np.uint16) for w in words]  # BUCKETS fits 16 bits
    return np.concatenate(each).astype(np.int32), np.concatenate([[0], np.cumsum([len(e) for e in each])])


def _means(rows: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Means of consecutive slices of rows; all slices hold something."""
    sizes = np.diff(at)
    return np.add.reduceat(rows, at[:-1], axis=0) / sizes[:, None]


def _leans(values: np.ndarray) -> np.ndarray:
    """Means of every ``PASSAGE`` consecutive values of a text, or of all if there are fewer; there is one value at least."""
    width = min(PASSAGE, len(values))
    sums = np.concatenate([[0.0], np.cumsum(values, dtype=np.float64)])
    return (sums[width:] - sums[:-width]) / width


@dataclass
class ToxicityModel:
    """Score of a bucket in the direction toxic minus clean, and the bias."""

    bucket: np.ndarray
    bias: float

    def word(self, word: str) -> float:
        return float(self.bucket[subwords(word)].mean())


def train(texts: list[str], labels: list[int], seed: int = 7) -> ToxicityModel:
    """Fits embeddings and softmax on texts with labels 0 or 1; with one class only, every score is that class's share."""
    rng = np.random.default_rng(seed)
    number: dict[str, int] = {}
    coded = [np.fromiter((number.setdefault(w, len(number)) for w in _WORD.findall((t or "").lower())), np.int32) for t in texts]
    kept = [i for i, c in enumerate(coded) if len(c)]
    y = np.array([labels[i] for i in kept], np.float64)
    prior = (sum(labels) + 0.5) / (len(labels) + 1)
    bias = float(np.log(prior / (1 - prior)))
    if not len(y) or y.min() == y.max():
        return ToxicityModel(np.zeros(BUCKETS, np.float32), bias)
    coded = [coded[i] for i in kept]
    flat, at = _bags(number)
    emb = rng.normal(0, 0.1, (BUCKETS, DIM))
    soft = rng.normal(0, 0.1, (2, DIM))
    shift = np.array([-bias / 2, bias / 2])
    emb_sq, soft_sq, shift_sq = np.full(BUCKETS, DAMPING), np.full((2, DIM), DAMPING), np.full(2, DAMPING)

    def epoch(bags: list[np.ndarray], rate: float) -> None:
        order = rng.permutation(len(bags))
        for batch in np.array_split(order, max(1, len(order) // 64)):
            seen, inverse = np.unique(np.concatenate([bags[i] for i in batch]), return_inverse=True)
            sizes = at[seen + 1] - at[seen]
            begin = np.concatenate([[0], np.cumsum(sizes)])
            buckets = flat[np.arange(begin[-1]) - np.repeat(begin[:-1] - at[seen], sizes)]
            lengths = np.array([len(bags[i]) for i in batch])
            bag = _means(_means(emb[buckets], begin)[inverse], np.concatenate([[0], np.cumsum(lengths)]))
            z = bag @ soft.T + shift
            p = np.exp(z - z.max(1, keepdims=True))
            p /= p.sum(1, keepdims=True)
            p[np.arange(len(batch)), y[batch].astype(int)] -= 1
            g_soft, g_shift = p.T @ bag, p.sum(0)
            each = np.repeat(p @ soft / lengths[:, None], lengths, axis=0)
            word = np.stack([np.bincount(inverse, each[:, k], len(seen)) for k in range(DIM)], 1)
            row = np.repeat(word / sizes[:, None], sizes, axis=0)
            g_emb = np.stack([np.bincount(buckets, row[:, k], BUCKETS) for k in range(DIM)], 1)
            for value, squares, g, weight in ((emb, emb_sq, g_emb, 1.0), (soft, soft_sq, g_soft, 0.1), (shift, shift_sq, g_shift, 0.1)):
                squares += (g**2).mean(1) if value is emb else g**2
                root = np.sqrt(squares)
                value -= rate * weight * g / (root[:, None] if value is emb else root)

    for _ in range(WHOLE):
        epoch(coded, RATE)
    for k in range(ROUNDS):
        lean = _means((emb @ (soft[1] - soft[0]))[flat][:, None], at)[:, 0]
        tops = [int(np.argmax(_leans(lean[c]))) for c in coded]
        bags = [c[t : t + PASSAGE] for c, t in zip(coded, tops)]
        for _ in range(INNER):
            epoch(bags, RATE * (1 - k / (ROUNDS + 1)))
    return ToxicityModel((emb @ (soft[1] - soft[0])).astype(np.float32), float(shift[1] - shift[0]))


def fit(docs: DataFrame, labels: DataFrame, use: Column, sample: int = SAMPLE) -> ToxicityModel:
    """Trains on ``sample`` documents, chosen by a hash of their id, that have a label and satisfy ``use`` (a column over doc_id)."""
    wanted = labels.where(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull() & use).select("doc_id", "toxic").dropDuplicates(["doc_id"])
    chosen = wanted.join(docs.select("doc_id").distinct(), "doc_id", "left_semi").orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    rows = docs.select("doc_id", "text").join(chosen, "doc_id").dropDuplicates(["doc_id"]).orderBy("doc_id").collect()  # at most `sample` rows
    return train([r["text"] for r in rows], [r["toxic"] for r in rows])


def _scoring(model):
    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model.value
        known: dict[str, float] = {}
        for batch in batches:
            for part in slices(batch, "text"):
                out = []
                for text in part.column("text").to_pylist():
                    words = _WORD.findall((text or "").lower())
                    if len(known) > REMEMBERED:
                        known.clear()
                    values = []
                    for w in words:
                        v = known.get(w)
                        if v is None:
                            v = known[w] = m.word(w)
                        values.append(v)
                    lean = m.bias
                    if values:
                        lean += float(_leans(np.array(values)).max())
                    out.append(1 / (1 + np.exp(-np.clip(lean, -50, 50))))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(out, pa.float64())], ["doc_id", "score"])

    return score


def toxicity(docs: DataFrame, model: ToxicityModel) -> DataFrame:
    """``(doc_id, text)`` to (doc_id, score between 0 and 1), one row per input row; other columns are ignored.

    Null, empty and wordless texts get the score of the bias alone; repeated rows are scored each; an empty table gives an empty result.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    return docs.select("doc_id", "text").mapInArrow(_scoring(shared), "doc_id long, score double")


def without_toxic(docs: DataFrame, model: ToxicityModel, threshold: float = THRESHOLD) -> DataFrame:
    """The documents that score under ``threshold``, all columns kept; an id is dropped with the row that is toxic, null ids stay."""
    toxic = toxicity(docs, model).where(F.col("score") >= threshold).select(F.col("doc_id").alias("id")).distinct()
    rows = docs.select(F.struct(*docs.columns).alias("row"), F.col("doc_id").alias("of"))
    return rows.join(toxic, F.col("of") == F.col("id"), "left_anti").select("row.*")
