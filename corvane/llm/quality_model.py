"""Quality classifier: hashed word n-grams, logistic regression by follow-the-regularised-leader updates.

Features of a text: its words (lower case), pairs of neighbouring words, the shapes of words (case, digits and symbols,
run lengths squeezed) and pairs of shapes, each hashed to one of ``2 ** BITS`` places; whether a word repeats the one
before counts as a shape. Counts are damped and scaled to length one. The model is fitted on the driver on at most
``MAX_TRAIN`` labelled documents (those of the smallest hashed id; of rows with one id, that of the smallest hashed text), up to
``MAX_FEATURES`` features in all, in the order of hashed id, whatever the partitions. All documents are scored as sparse dot
products.

Defined results: null and empty texts have no feature and score the model's prior; labelled rows without quality are
skipped, and two labels of one id are two rows; repeated rows are scored each; without labels every score is 0.5; an empty table
gives no rows; a text of any length is one row of features. Columns besides ``doc_id``, ``text`` and ``quality`` are not looked at.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.llm.common import materialize, spread

BITS = 20
#: Labelled documents that the model is fitted on, at most.
MAX_TRAIN = 6000
#: Features of them that reach the driver, at most (12 bytes each).
MAX_FEATURES = 20_000_000
EPOCHS = 6
ALPHA, BETA, L1, L2 = 1.0, 1.0, 0.05, 1.0
FOLDS, HELD_OUT = 3, 1
CACHE_WORDS = 200_000

_SQUEEZE = re.compile(rb"(.)\1+")
_CLASSES = bytes(
    65 if 65 <= c <= 90 else 97 if 97 <= c <= 122 or c >= 128 else 57 if 48 <= c <= 57 else c for c in range(256)
)


class Featurizer:
    """Sparse features of texts; words already met are looked up."""

    def __init__(self, bits: int = BITS):
        self.mask = np.uint64((1 << bits) - 1)
        self.cache: dict[bytes, tuple[int, int]] = {}

    def _word(self, word: bytes) -> tuple[int, int]:
        if len(self.cache) >= CACHE_WORDS:
            self.cache.clear()
        shape = _SQUEEZE.sub(rb"\1", word.translate(_CLASSES))
        got = self.cache[word] = (xxhash.xxh64_intdigest(word.lower(), 7), xxhash.xxh64_intdigest(shape, 11))
        return got

    def __call__(self, text: str | None) -> tuple[np.ndarray, np.ndarray]:
        words = (text or "").encode("utf-8", "replace").split()
        if not words:
            return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.float32)
        get, make = self.cache.get, self._word
        both = np.array([get(w) or make(w) for w in words], dtype=np.uint64)
        word, shape = both[:, 0], both[:, 1].copy()
        shape[1:][word[1:] == word[:-1]] += np.uint64(1)
        prime = np.uint64(0x9E3779B97F4A7C15)
        pair = (word[:-1] * prime ^ word[1:]) * prime >> np.uint64(20)
        shapes = (shape[:-1] * prime ^ shape[1:]) * prime >> np.uint64(21)
        index, counts = np.unique(np.concatenate([word, pair, shape, shapes]) & self.mask, return_counts=True)
        value = np.sqrt(counts)
        return index.astype(np.int64), (value / np.sqrt((value * value).sum())).astype(np.float32)


def fit(rows: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, bits: int = BITS, epochs: int = EPOCHS) -> tuple[np.ndarray, float]:
    """Weights and bias after per-coordinate follow-the-regularised-leader steps, in a fixed order."""
    z, n, w = (np.zeros((1 << bits) + 1) for _ in range(3))
    bias = 1 << bits
    order = np.random.default_rng(0)
    for _ in range(epochs):
        for k in order.permutation(len(rows)):
            index, value = np.append(rows[k][0], bias), np.append(rows[k][1], np.float32(1))
            zi, ni = z[index], n[index]
            l1 = np.full(len(index), L1)
            l1[-1] = 0.0
            wi = np.where(np.abs(zi) > l1, -(zi - np.sign(zi) * l1) / ((BETA + np.sqrt(ni)) / ALPHA + L2 * 0.01), 0.0)
            p = 1.0 / (1.0 + np.exp(-np.clip(wi @ value, -30, 30)))
            g = (p - labels[k]) * value
            step = (np.sqrt(ni + g * g) - np.sqrt(ni)) / ALPHA
            z[index] = zi + g - step * wi
            n[index] = ni + g * g
    l1 = np.full(len(z), L1)
    l1[-1] = 0.0
    w = np.where(np.abs(z) > l1, -(z - np.sign(z) * l1) / ((BETA + np.sqrt(n)) / ALPHA + L2 * 0.01), 0.0)
    return w[:-1].astype(np.float32), float(w[-1])


def fold(doc_id, folds: int = FOLDS, held_out: int = HELD_OUT):
    """Whether an id is held out: crc32 of its text (null: empty) modulo ``folds``."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % folds == held_out


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    make = Featurizer()
    for batch in batches:
        found = [make(t.as_py()) for t in batch.column(0)]
        yield pa.RecordBatch.from_arrays(
            [*batch.columns[1:], pa.array([i.astype(np.int32) for i, _ in found], pa.list_(pa.int32())), pa.array([v for _, v in found], pa.list_(pa.float32()))],
            names=["quality", "h", "id", "i", "v"])


def train(docs: DataFrame, labels: DataFrame, max_train: int = MAX_TRAIN) -> tuple[np.ndarray, float]:
    """Fit on labelled documents outside the held-out fold; the sample bounds what reaches the driver."""
    usable = labels.where(F.col("quality").isNotNull() & ~fold(F.col("doc_id"))).select("doc_id", "quality")
    chosen = usable.orderBy(F.xxhash64("doc_id"), "doc_id", "quality").limit(max_train)
    texts = docs.select("doc_id", F.col("text").cast("string").alias("text")).join(F.broadcast(chosen), "doc_id")
    one = texts.groupBy("doc_id", "quality").agg(F.min_by("text", F.xxhash64("text")).alias("text"))
    found = one.select("text", F.col("quality").cast("int").alias("quality"), F.xxhash64("doc_id").alias("h"), F.col("doc_id").cast("string").alias("id")).mapInArrow(
        _features, "quality int, h long, id string, i array<int>, v array<float>")
    rows, labelled, size = [], [], 0
    for r in materialize(found, "features").orderBy("h", "id", "quality").toLocalIterator():
        size += len(r.i)
        if size > MAX_FEATURES and rows:
            break
        rows.append((np.asarray(r.i, dtype=np.int64), np.asarray(r.v, dtype=np.float32)))
        labelled.append(float(r.quality))
    if not rows:
        return np.zeros(1 << BITS, dtype=np.float32), 0.0
    return fit(rows, np.array(labelled))


def _score(weights: np.ndarray, bias: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        make = Featurizer()
        for batch in batches:
            sums = np.empty(batch.num_rows)
            for k, text in enumerate(batch.column("text")):
                index, value = make(text.as_py())
                sums[k] = weights[index] @ value if len(index) else 0.0
            score = 1.0 / (1.0 + np.exp(-np.clip(sums + bias, -30, 30)))
            cols = [batch.column("doc_id"), batch.column("held_out"), pa.array(score), pa.array((score >= 0.5).astype(np.int32))]
            yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "held_out", "score", "predicted"])

    return run


def classify(docs: DataFrame, labels: DataFrame, max_train: int = MAX_TRAIN) -> DataFrame:
    """One row a document: ``held_out``, ``score`` and ``predicted``."""
    weights, bias = train(docs, labels, max_train)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), fold(F.col("doc_id")).alias("held_out"), F.col("text").cast("string").alias("text"))
    return spread(texts).mapInArrow(_score(weights, bias), "doc_id long, held_out boolean, score double, predicted int")
