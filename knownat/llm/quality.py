"""Quality of texts by supervised subword embeddings.

A text has three bags of hashed features: its words, the character 3- to 5-grams of its words with their edges, and its pairs of neighbouring
words, where a word that repeats the one before is written as "the same", so stuttering is one feature whichever word stutters.  Case and
punctuation are kept, as they tell quality.  Every feature has a learned vector; a text is the mean of the means of its bags, read by a
softmax over two classes.  Vectors and softmax are trained together by stochastic gradient descent in numpy.  As softmax and means are
linear, a trained model is one number per feature, and scoring is a lookup and a mean for a whole slice of texts at once.

Training sees at most ``SAMPLE`` labelled texts; scoring sees every whole text, in blocks of at most ``BLOCK`` characters cut at white space.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from knownat.llm.text import SpanHash, mix, slices

#: Labelled texts, chosen by a hash of their id, that a model is fitted on at most.
SAMPLE = 6000
BUCKETS = 1 << 18
DIM = 8
GRAMS = (3, 4, 5)
#: Gradient steps, one text each, in all, however few texts there are; after each of the rounds the model is tried on a held-out share.
STEPS = 12000
ROUNDS = 8
HELD = 0.1
RATE = 0.2
#: Where the squared gradients of a feature start: the larger, the less a rare feature learns from one text.
DAMPING = 1e-4
BLOCK = 1 << 19
THRESHOLD = 0.7
#: Code points up to here are looked up; none above is white space.
_SPACE = np.zeros(0x21, dtype=bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_SAME = np.uint64(0x5851F42D4C957F2D)

#: Bags of features, each some runs of (buckets, n + 1 places where each text's begin).
Bags = list[list[tuple[np.ndarray, np.ndarray]]]


def blocks(text: str) -> list[str]:
    """Pieces of at most ``BLOCK`` characters, cut at white space where there is some in the second half."""
    out, at = [], 0
    while len(text) - at > BLOCK:
        end = max(text.rfind(c, at + BLOCK // 2, at + BLOCK) for c in " \n\t") + 1 or at + BLOCK
        out.append(text[at:end])
        at = end
    return [*out, text[at:]]


def features(texts: list[str]) -> Bags:
    """Buckets of words, of character n-grams and of word pairs of each text."""
    codes = np.frombuffer("".join(f" {t} " for t in texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    at = np.concatenate([[0], np.cumsum([len(t) + 2 for t in texts], dtype=np.int64)])
    space = _SPACE[np.minimum(codes, 0x20)] & (codes <= 0x20)
    edge = np.diff(space.astype(np.int8))
    start, end = np.flatnonzero(edge == -1) + 1, np.flatnonzero(edge == 1) + 1
    first = np.searchsorted(start, at)
    word = SpanHash(codes).of(start, end)
    # n-grams of a word and its edges: white space, always the same symbol, stands first or last at most
    flat = np.where(space, np.uint64(0x20), codes.astype(np.uint64))
    spaces = np.concatenate([[0], np.cumsum(space, dtype=np.int32)])
    grams = []
    for n in GRAMS:
        size = max(0, len(flat) - n + 1)
        spot = np.flatnonzero(spaces[n - 1 : n - 1 + size] == spaces[1 : 1 + size])
        value = np.full(len(spot), np.uint64(n))
        for k in range(n):
            value = value * np.uint64(0x9E3779B97F4A7C15) + flat[spot + k]
        grams.append((_buckets(value, 1), np.searchsorted(spot, at)))
    # pairs of neighbours in one text
    joint = np.ones(max(0, len(word) - 1), dtype=bool)
    breaks = first[1:-1]
    joint[breaks[(breaks > 0) & (breaks < len(word))] - 1] = False
    left = np.flatnonzero(joint)
    same = word[left] == word[left + 1]
    pair = np.where(same, _SAME, word[left] * np.uint64(0xD6E8FEB86659FD93) + word[left + 1])
    return [[(_buckets(word, 0), first)], grams, [(_buckets(pair, 2), np.searchsorted(left, first))]]


def _buckets(values: np.ndarray, kind: int) -> np.ndarray:
    return (mix(values + np.uint64(kind)) % np.uint64(BUCKETS)).astype(np.int32)


@dataclass
class QualityModel:
    """What a feature adds in the direction good minus bad, and the bias."""

    feature: np.ndarray
    bias: float

    def scores(self, texts: list[str | None]) -> np.ndarray:
        """Probability of label 1 of each text."""
        pieces = [(d, b) for d, t in enumerate(texts) for b in blocks(t or "")]
        sums, counts = np.zeros((len(texts), 3)), np.zeros((len(texts), 3))
        group = np.cumsum([len(b) for _, b in pieces], dtype=np.int64) // BLOCK
        for lo, hi in zip(*_runs(group)):
            owner = np.array([d for d, _ in pieces[lo:hi]])
            for bag, runs in enumerate(features([b for _, b in pieces[lo:hi]])):
                for buckets, first in runs:
                    total = np.concatenate([[0.0], np.cumsum(self.feature[buckets], dtype=np.float64)])
                    np.add.at(sums[:, bag], owner, total[first[1:]] - total[first[:-1]])
                    np.add.at(counts[:, bag], owner, np.diff(first))
        lean = (sums / np.maximum(counts, 1)).sum(axis=1) / np.maximum((counts > 0).sum(axis=1), 1) + self.bias
        return 1 / (1 + np.exp(-np.clip(lean, -50, 50)))


def _runs(group: np.ndarray) -> tuple[list[int], list[int]]:
    """Where runs of equal values begin and end."""
    cuts = [0, *(np.flatnonzero(np.diff(group)) + 1).tolist(), len(group)]
    return cuts[:-1], cuts[1:]


def _weighted(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Different buckets of a text and their weights in its mean of means."""
    bags = [[] for _ in range(3)]
    for block in blocks(text):
        for k, runs in enumerate(features([block])):
            bags[k] += [b for b, _ in runs]
    whole = [np.concatenate(b) for b in bags if sum(map(len, b))]
    if not whole:
        return np.zeros(0, np.int32), np.zeros(0, np.float32)
    seen, inverse = np.unique(np.concatenate(whole), return_inverse=True)
    weights = np.concatenate([np.full(len(b), 1 / (len(b) * len(whole))) for b in whole])
    return seen, np.bincount(inverse, weights).astype(np.float32)


def train(texts: list[str | None], labels: list[int], seed: int = 7) -> QualityModel:
    """Fits vectors and softmax on texts with labels 0 or 1; with one class only, every score is near that class's share."""
    rng = np.random.default_rng(seed)
    prior = (sum(labels) + 0.5) / (len(labels) + 1)
    bias = float(np.log(prior / (1 - prior)))
    rows = [(w, y) for w, y in ((_weighted(t or ""), y) for t, y in zip(texts, labels)) if len(w[0])]
    if len({y for _, y in rows}) < 2:
        return QualityModel(np.zeros(BUCKETS, np.float32), bias)
    order = rng.permutation(len(rows))
    aside = order[: int(len(rows) * HELD)]
    used = order[len(aside) :]
    emb = rng.normal(0, 0.1, (BUCKETS, DIM)).astype(np.float32)
    soft, shift = rng.normal(0, 0.1, (2, DIM)), np.array([-bias / 2, bias / 2])
    emb_sq, soft_sq, shift_sq = np.full(BUCKETS, DAMPING, np.float32), np.full((2, DIM), 1.0), np.full(2, 1.0)
    best, least, turn = None, np.inf, np.zeros(0, int)
    for k in range(ROUNDS):
        rate = RATE * (1 - k / ROUNDS)
        need = STEPS // ROUNDS
        while len(turn) < need:
            turn = np.concatenate([turn, rng.permutation(used)])
        for i in turn[:need]:
            (ids, weight), y = rows[i]
            vectors = emb[ids]
            mean = weight @ vectors
            z = soft @ mean + shift
            p = np.exp(z - z.max())
            p /= p.sum()
            p[y] -= 1
            back = p @ soft
            emb_sq[ids] += weight**2 * np.float32(np.mean(back**2))
            emb[ids] = vectors - rate * np.outer(weight / np.sqrt(emb_sq[ids]), back)
            for value, squares, g in ((soft, soft_sq, np.outer(p, mean)), (shift, shift_sq, p)):
                squares += g**2
                value -= 0.1 * rate * g / np.sqrt(squares)
        turn = turn[need:]
        model = QualityModel((emb @ (soft[1] - soft[0])).astype(np.float32), float(shift[1] - shift[0]))
        lean = np.array([w @ model.feature[ids] + model.bias for (ids, w), _ in (rows[i] for i in aside)])
        loss = float(np.logaddexp(0, np.where([rows[i][1] for i in aside], -lean, lean)).mean()) if len(aside) else 0.0
        if loss <= least:
            best, least = model, loss
    return best


def fit(docs: DataFrame, labels: DataFrame, use: Column, sample: int = SAMPLE) -> QualityModel:
    """Trains on at most ``sample`` rows, chosen by a hash, of documents with a quality label that satisfy ``use`` (a column over doc_id).

    An id with several labels counts with its least; of repeated ids with different texts the least text is used, so a fit can be repeated.
    """
    wanted = labels.where(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull() & use).groupBy("doc_id").agg(F.min("quality").alias("quality"))
    chosen = wanted.join(docs.select("doc_id").distinct(), "doc_id", "left_semi").orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    rows = docs.select("doc_id", "text").join(chosen, "doc_id").groupBy("doc_id").agg(F.min(F.struct("text", "quality")).alias("row"))
    got = sorted(rows.select("doc_id", "row.*").collect(), key=lambda r: r["doc_id"])  # at most `sample` rows
    return train([r["text"] for r in got], [r["quality"] for r in got])


def _scoring(model):
    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                out = model.value.scores(part.column("text").to_pylist())
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(out, pa.float64())], ["doc_id", "score"])

    return score


def quality(docs: DataFrame, model: QualityModel) -> DataFrame:
    """``(doc_id, text)`` to (doc_id, score between 0 and 1), one row per input row; other columns are ignored.

    Null, empty and blank texts get the score of the bias alone; repeated rows are scored each; an empty table gives an empty result.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)  # BUCKETS numbers, 1 MB
    return docs.select("doc_id", "text").mapInArrow(_scoring(shared), "doc_id long, score double")
