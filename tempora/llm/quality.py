"""Quality classifier: hashed word n-gram logistic regression, trained with follow-the-regularised-leader updates.

A word gives two symbols: its lower-cased bytes, and its shape (runs of upper, lower, digit and mark characters). The
features are hashed uni- and bigrams of both; a bigram of shapes also says whether the two words are equal. A feature's
value is its share of the text's n-grams times SCALE, so a score is the mean of the weights met: a sparse dot product
with no look at a text's length, its language column or its source.

Training streams a bounded, hash-chosen sample of labelled rows (`rows`, a parameter) `passes` times over through one task,
which holds the weights and one Arrow batch: every row is learnt as often as any other, whatever their lengths. Weights
are 2^BITS floats whatever the corpus: that bounds the broadcast.

Edge cases: null, empty and word-less texts get the score of the bias alone; without labels every score is 0.5; very long
texts are read whole, PIECE words at a time; every row returns one row; rows with a null label teach nothing, a repeated
id teaches once; columns of docs may have any names beside doc_id and text.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LOWER, give_back, id_crc, sample_labels, utf8

BITS = 18
SCALE = 24.0
#: Words taken at once; a longer text is taken in pieces.
PIECE = 1 << 15
SHAPE = bytes(
    0x41 if 0x41 <= b <= 0x5A else 0x61 if 0x61 <= b <= 0x7A or b >= 0x80 else 0x39 if 0x30 <= b <= 0x39 else b
    for b in range(256)
)
RUN = re.compile(rb"(.)\1+", re.S)
MULTIPLY = np.uint64(0x9E3779B97F4A7C15)


class Features:
    """Hashed features of a text, as runs of indices."""

    def __init__(self):
        self.shapes: dict[bytes, int] = {}

    def _shape(self, word: bytes) -> int:
        if len(self.shapes) > 200_000:
            self.shapes.clear()
        code = self.shapes[word] = zlib.crc32(RUN.sub(rb"\1", word))
        return code

    def of(self, text: bytes | None) -> Iterator[np.ndarray]:
        text = text or b""
        words, shaped = text.translate(LOWER).split(), text.translate(SHAPE).split()
        known, shape, crc = self.shapes, self._shape, zlib.crc32
        shift = np.uint64(64 - BITS)
        for at in range(0, len(words), PIECE):
            part, forms = words[at : at + PIECE + 1], shaped[at : at + PIECE + 1]
            n = min(len(part), PIECE)
            w = np.fromiter(map(crc, part), np.uint64, len(part))
            s = np.fromiter([known[x] if x in known else shape(x) for x in forms], np.uint64, len(forms))
            same = (w[1:] == w[:-1]).astype(np.uint64)
            hashed = np.concatenate(
                [
                    w[:n] + np.uint64(1 << 33),
                    s[:n] + np.uint64(2 << 33),
                    w[:-1] * np.uint64(31) + w[1:] + np.uint64(3 << 40),
                    s[:-1] * np.uint64(37) + s[1:] * np.uint64(2) + same + np.uint64(5 << 40),
                ]
            )
            yield ((hashed * MULTIPLY) >> shift).astype(np.int64)


class Leader:
    """Follow-the-regularised-leader for logistic loss (McMahan et al., 2013)."""

    def __init__(self, alpha: float = 0.6, beta: float = 1.0, l1: float = 0.02, l2: float = 0.1):
        self.alpha, self.beta, self.l1, self.l2 = alpha, beta, l1, l2
        self.z, self.n = np.zeros((1 << BITS) + 1), np.zeros((1 << BITS) + 1)

    def weights(self, at) -> np.ndarray:
        z, n = self.z[at], self.n[at]
        w = -(z - np.sign(z) * self.l1) / ((self.beta + np.sqrt(n)) / self.alpha + self.l2)
        return np.where(np.abs(z) <= self.l1, 0.0, w)

    def learn(self, at: np.ndarray, x: np.ndarray, label: int) -> None:
        w = self.weights(at)
        g = (1 / (1 + np.exp(-np.clip(w @ x, -35, 35))) - label) * x
        sigma = (np.sqrt(self.n[at] + g * g) - np.sqrt(self.n[at])) / self.alpha
        self.z[at] += g - sigma * w
        self.n[at] += g * g


def _row(features: Features, text: bytes | None) -> tuple[np.ndarray, np.ndarray]:
    """Sparse row: distinct indices and values; the last index is the bias."""
    found = [np.unique(x, return_counts=True) for x in features.of(text)]
    bias = np.array([1 << BITS])
    if not found:
        return bias, np.ones(1)
    at, back = np.unique(np.concatenate([x for x, _ in found]), return_inverse=True)
    n = np.bincount(back, np.concatenate([k for _, k in found]).astype(float))
    return np.concatenate([at, bias]), np.concatenate([n * (SCALE / n.sum()), np.ones(1)])


def train(docs: DataFrame, labels: DataFrame, label: str, keep, rows: int = 6000, passes: int = 3, **leader) -> np.ndarray:
    """Weights (the last is the bias) from at most `rows` labelled rows that `keep` admits."""
    chosen = sample_labels(labels, label, keep, rows)
    lessons = (
        docs.select("doc_id", utf8().alias("text")).join(F.broadcast(chosen), "doc_id")  # at most `rows` ids
        .groupBy("order", "doc_id", "label").agg(F.min("text").alias("text"))  # a repeated id teaches once
        .withColumn("pass", F.explode(F.sequence(F.lit(1), F.lit(passes))))
        .repartition(1)
        .sortWithinPartitions("pass", "order", "doc_id")
        .select("label", "text")
    )

    def fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, features = Leader(**leader), Features()
        for batch in batches:
            for y, text in zip(batch.column("label"), batch.column("text"), strict=True):
                at, x = _row(features, text.as_py())
                model.learn(at, x, y.as_py())
        w = model.weights(np.arange(len(model.z))).astype(np.float32)
        yield pa.RecordBatch.from_arrays([pa.array([w.tobytes()], pa.binary())], names=["w"])
        model = features = w = batch = None
        give_back()

    found = lessons.mapInArrow(fit, "w binary").collect()
    return np.frombuffer(found[0].w, np.float32) if found else np.zeros((1 << BITS) + 1, np.float32)


def score_column(spark, weights: np.ndarray):
    """A function of a text column (as bytes) that gives the probability of label 1."""
    shared = spark.sparkContext.broadcast(weights)

    @F.arrow_udf("double")
    def score(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        w, features = shared.value, Features()
        for texts in batches:
            out = np.empty(len(texts))
            for i, x in enumerate(texts):
                total, n = 0.0, 0
                for at in features.of(x.as_py()):
                    total += float(w[at].sum(dtype=np.float64))
                    n += len(at)
                out[i] = float(w[-1]) + (SCALE * total / n if n else 0.0)
            yield pa.array(1 / (1 + np.exp(-np.clip(out, -35, 35))))
        features = texts = None
        give_back()

    return score


#: Rows whose crc32(doc_id) leaves this remainder are held out.
FOLDS, HELD = 5, 0


def held_out(doc_id):
    return F.pmod(id_crc(doc_id), F.lit(FOLDS)) == HELD


def quality_scores(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, rows: int = 6000) -> DataFrame:
    """(doc_id, held_out, score, predicted) for each row of docs."""
    score = score_column(docs.sparkSession, train(docs, labels, "quality", lambda c: ~held_out(c), rows))
    return docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), score(utf8()).alias("score")).withColumn(
        "predicted", (F.col("score") >= threshold).cast("int")
    )


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, rows: int = 6000) -> DataFrame:
    """The rows of docs that the classifier does not reject. It learns from the labelled rows still in docs."""
    score = score_column(docs.sparkSession, train(docs, labels, "quality", lambda c: ~held_out(c), rows))
    return docs.where(score(utf8()) >= threshold)
