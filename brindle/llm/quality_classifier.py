"""Naive Bayes support vectors for text quality.

Features are indicators of word unigrams and bigrams, hashed to ``2 ** BITS``
places, and scaled by the log ratio of the classes' smoothed counts. A linear
hinge-loss model is fitted on them by dual coordinate descent.

The model is fitted on at most ``TRAIN_ROWS`` labelled texts, those with the lowest
hash of their id, each with all its words; a document's features are sorted out on the
executors and only their places come to the driver. Scoring covers every text in full.

Defined results: a null or empty text has no features and gets the score of the bias;
repeated rows get equal scores; labels other than 0 and 1, null labels and labels of
ids that don't occur are not learnt from; without labels of both classes every
score is the share of label 1 (0.5 without any); other columns are not read.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Labelled texts that a model is fitted on, at most.
TRAIN_ROWS = 6000
#: Places for features.
BITS = 18
#: Passes of the descent, cost of a margin error, smoothing of the counts.
PASSES, COST, SMOOTH = 12, 0.1, 1.0
#: Words whose hashes a task remembers.
REMEMBER = 200_000

_SEPARATORS = bytes(b + 32 if 0x41 <= b <= 0x5A else b for b in range(256))


class Features:
    """Distinct places of a text's unigrams and bigrams. Words are split at ASCII white space and A-Z is lower-cased."""

    def __init__(self) -> None:
        self.known: dict[bytes, int] = {}

    def of(self, text: bytes | None) -> np.ndarray:
        from xxhash import xxh32_intdigest

        words = text.translate(_SEPARATORS).split() if text else []
        if not words:
            return np.zeros(0, dtype=np.int32)
        known = self.known
        if len(known) > REMEMBER:
            known.clear()
        for word in set(words):
            if word not in known:
                known[word] = xxh32_intdigest(word)
        one = np.array([known[w] for w in words], dtype=np.uint64)
        two = one[:-1] * np.uint64(0x9E3779B1) + one[1:] * np.uint64(0x85EBCA77)
        mixed = np.concatenate((one * np.uint64(0xC2B2AE3D27D4EB4F), two * np.uint64(0x9E3779B185EBCA87)))
        return np.unique(mixed >> np.uint64(64 - BITS)).astype(np.int32)


@dataclass
class Model:
    """Weights by place, ratios already in them."""

    weights: np.ndarray
    bias: float

    def margin(self, places: np.ndarray) -> float:
        """Texts of any length count alike: features are scaled to length 1."""
        return float(self.weights[places].sum() / np.sqrt(max(1, len(places))) + self.bias)

    def score(self, places: np.ndarray) -> float:
        """0 to 1; 0.5 on the boundary."""
        return float(1 / (1 + np.exp(-np.clip(2 * self.margin(places), -60, 60))))


def fit(texts: list[np.ndarray], labels: np.ndarray, passes: int = PASSES, cost: float = COST, seed: int = 7) -> Model:
    """The model for labels 0 and 1. Rows weigh so that both classes have the same sum."""
    size = 1 << BITS
    positive = int(labels.sum())
    if positive in (0, len(labels)):
        share = positive / len(labels) if len(labels) else 0.5
        share = min(max(share, 1e-6), 1 - 1e-6)
        return Model(np.zeros(size), float(np.log(share / (1 - share)) / 2))
    counts = np.full((2, size), SMOOTH)
    for places, label in zip(texts, labels):
        counts[label, places] += 1
    ratios = np.log(counts[1] / counts[1].sum()) - np.log(counts[0] / counts[0].sum())
    values = [ratios[p] / np.sqrt(max(1, len(p))) for p in texts]
    squares = np.array([v @ v + 1 for v in values])
    signs = np.where(labels == 1, 1.0, -1.0)
    most = cost * len(labels) / 2 / np.where(labels == 1, positive, len(labels) - positive)
    weights, bias, alpha = np.zeros(size), 0.0, np.zeros(len(texts))
    rng = np.random.default_rng(seed)
    for _ in range(passes):
        for i in rng.permutation(len(texts)):
            places, value, sign = texts[i], values[i], signs[i]
            slope = sign * (weights[places] @ value + bias) - 1
            new = min(max(alpha[i] - slope / squares[i], 0.0), most[i])
            step = (new - alpha[i]) * sign
            if step:
                weights[places] += step * value
                bias += step
                alpha[i] = new
    return Model(weights * ratios, float(bias))


@F.arrow_udf(T.ArrayType(T.IntegerType()))
def _places(texts: pa.Array) -> pa.Array:
    features = Features()
    return pa.array([features.of(t) for t in texts.cast(pa.binary()).to_pylist()], pa.list_(pa.int32()))


def held_out(doc_id: Column) -> Column:
    """True for ids that no label is learnt from: crc32 of the id as text, by 3, leaves 1."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 3 == 1


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", id_col: str = "doc_id", text: str = "text", rows: int = TRAIN_ROWS) -> Model:
    """Fit on the labelled documents that aren't held out, ``rows`` of them at most."""
    order = [F.xxhash64("id", F.lit(11)), "id", "label"]
    chosen = labels.select(F.col(id_col).alias("id"), F.col(label).cast("int").alias("label")).where(F.col("label").isin(0, 1) & F.col("id").isNotNull() & ~held_out(F.col("id")))
    chosen = chosen.distinct().orderBy(*order).limit(rows)
    texts = docs.select(F.col(id_col).alias("id"), F.col(text).alias("text")).join(F.broadcast(chosen), "id")
    # An id may stand for many rows: the bound holds for rows too.
    found = texts.orderBy(*order, F.xxhash64("text")).limit(rows).select("label", _places("text").alias("places"))
    seen, marks = [], []
    for row in found.toLocalIterator():
        seen.append(np.array(row.places, dtype=np.int32))
        marks.append(row.label)
    return fit(seen, np.array(marks, dtype=np.int64))


def scorer(spark: SparkSession, model: Model):
    """A function from a text column to its score. The model has a fixed size (2 MB)."""
    shared = spark.sparkContext.broadcast(model)

    @F.arrow_udf(T.DoubleType())
    def score(texts: pa.Array) -> pa.Array:
        features = Features()
        return pa.array([shared.value.score(features.of(t)) for t in texts.cast(pa.binary()).to_pylist()], pa.float64())

    return score
