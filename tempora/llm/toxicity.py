"""Toxicity: maximum-scoring segments over token log-odds, calibrated as extremes.

Log-odds of a token between toxic and other labelled texts carry an informative Dirichlet prior from the tokens of
both (Monroe, Colaresi and Quinn, 2008). What is counted is a token's different left neighbours, not its occurrences:
copies of a text and words repeated in a row then teach nothing twice. A token scores its log-odds if its likelihood
ratio's signed root is `z_least` or more. Every other token costs `drift`, so a text's expected score falls. Ruzzo and Tompa's scan then finds all maximal
scoring segments in linear time; here it walks the scoring tokens only, since the drift between them is known. Each
segment's chance of arising in ordinary text is E = K n exp(-lambda S) (Karlin and Altschul), lambda solved from the
sample's clean texts and K fitted to the segments found there; a text's evidence is the sum of -ln E over segments with E < 1 and its best one, and a
logistic fit of those on the sample gives the probability.

Training streams at most `rows` labelled rows (a parameter) chosen by hash. The lexicon holds only tokens that pass
that test, so its size is bounded by the sample.

Edge cases: null, empty and word-less texts have no segment and get the score of no evidence; without toxic labels
every score is that of no evidence, 0.5 if there are no labels at all; very long texts are scanned whole; every row returns
one row; a repeated id teaches once; columns of docs may have any names beside doc_id and text.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WORDS, durable, give_back, id_crc, sample_labels, utf8

#: Rows whose crc32(doc_id) leaves this remainder are held out.
FOLDS, HELD = 3, 1
#: Contexts of tokens that a training task holds at once.
CONTEXTS = 1 << 17


def held_out(doc_id):
    return F.pmod(id_crc(doc_id), F.lit(FOLDS)) == HELD


def log_odds(t, c, toxic: int, clean: int, prior: float = 500.0):
    """(delta, ratio) of a token: columns t and c are its counts in toxic and other texts, of `toxic` and `clean` in all.

    delta is the difference of log-odds under a Dirichlet prior of the token's share in both; ratio the likelihood-ratio
    statistic for its share being the same in both.
    """
    both, total = t + c, float(toxic + clean)
    alpha = F.lit(prior / total) * both
    odds = lambda k, n: F.log((k + alpha) / F.greatest(F.lit(n + prior) - k - alpha, F.lit(1e-9)))
    part = lambda k, n: F.when(k > 0, k * F.log(k / (both * F.lit(n / total)))).otherwise(0.0)
    return odds(t, toxic) - odds(c, clean), 2 * (part(t, toxic) + part(c, clean))


@dataclass
class Model:
    lexicon: dict[bytes, float] = field(default_factory=dict)
    drift: float = 0.25
    rate: float = 1.0
    k: float = 0.1
    bias: float = 0.0
    slope: tuple[float, float] = (0.0, 0.0)


def segments(hits: list[tuple[int, float]], drift: float) -> list[tuple[int, int, float]]:
    """All maximal scoring segments as (first token, last token, score); hits are (position, score) in order."""
    stack: list[tuple[int, int, float, float]] = []  # first, last, sum before, sum up to the end
    running, at = 0.0, 0
    for position, value in hits:
        running -= drift * (position - at)
        at = position + 1
        if value <= 0:
            running += value
            continue
        first, last, left, right = position, position, running, running + value
        running = right
        while True:
            j = len(stack) - 1
            while j >= 0 and stack[j][2] >= left:
                j -= 1
            if j < 0 or stack[j][3] >= right:
                stack.append((first, last, left, right))
                break
            first, left = stack[j][0], stack[j][2]
            del stack[j:]
    return [(first, last, right - left) for first, last, left, right in stack]


def scan(model: Model, text: bytes | None) -> tuple[list[tuple[int, int, float]], int]:
    """The segments of a text and its number of tokens."""
    words = (text or b"").translate(WORDS).split()
    lexicon = model.lexicon
    hits = [(i, lexicon[w] - model.drift) for i, w in enumerate(words) if w in lexicon]
    return segments(hits, model.drift), len(words)


def evidence(model: Model, text: bytes | None) -> tuple[float, float]:
    """(total, best) -ln E of a text's significant segments."""
    found, n = scan(model, text)
    gains = [model.rate * s - math.log(model.k * max(n, 1)) for _, _, s in found]
    gains = [g for g in gains if g > 0]
    return sum(gains), max(gains, default=0.0)


def _solve_rate(scores: list[float], shares: list[float], drift: float) -> float:
    """The positive root of sum p exp(lambda s) = 1 over tokens of clean text; 1 where nothing scores."""
    if not scores or sum(p * s for p, s in zip(shares, scores, strict=True)) - drift * (1 - sum(shares)) >= 0:
        return 1.0
    value = lambda x: sum(p * math.exp(x * s) for p, s in zip(shares, scores, strict=True)) + (1 - sum(shares)) * math.exp(-x * drift) - 1
    low, high = 1e-6, 20.0 / max(scores)
    for _ in range(80):
        mid = (low + high) / 2
        low, high = (mid, high) if value(mid) < 0 else (low, mid)
    return min(max(low, 0.05), 5.0)


def _logistic(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Logistic regression by Newton's method with a small ridge."""
    x = np.column_stack([np.ones(len(x)), x])
    w = np.zeros(x.shape[1])
    for _ in range(40):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -35, 35)))
        h = (x * (p * (1 - p))[:, None]).T @ x + 1e-2 * np.eye(len(w))
        w -= np.linalg.solve(h, x.T @ (p - y) + 1e-2 * w)
    return w


def _features(total: float, best: float) -> tuple[float, float]:
    return math.log1p(total), math.log1p(best)


def train(docs: DataFrame, labels: DataFrame, rows: int = 6000, z_least: float = 4.0) -> Model:
    chosen = sample_labels(labels, "toxic", lambda c: ~held_out(c), rows)
    taught = docs.select("doc_id", utf8().alias("text")).join(F.broadcast(chosen), "doc_id")  # at most `rows` ids
    lessons = durable(taught.groupBy("doc_id", "label").agg(F.min("text").alias("text")).select("label", "text"), "lessons")

    def emitted(seen: set) -> pa.RecordBatch:
        y, token, left = zip(*seen, strict=True)
        return pa.RecordBatch.from_arrays([pa.array(y, pa.int32()), pa.array(token, pa.binary()), pa.array(left, pa.int64())], names=["y", "token", "left"])

    def contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seen: set[tuple[int, bytes, int]] = set()
            for y, text in zip(batch.column("label").to_pylist(), batch.column("text"), strict=True):
                words = (text.as_py() or b"").translate(WORDS).split()
                for at in range(0, len(words), CONTEXTS):
                    part = words[at : at + CONTEXTS]
                    before = [words[at - 1] if at else b"", *part]
                    seen.update(zip([int(y > 0)] * len(part), part, map(zlib.crc32, before), strict=False))
                    if len(seen) >= CONTEXTS:
                        yield emitted(seen)
                        seen = set()
            if seen:
                yield emitted(seen)
        batch = seen = None
        give_back()

    table = lessons.mapInArrow(contexts, "y int, token binary, left bigint").distinct()
    one = lambda y: F.count(F.when(F.col("y") == y, 1))
    wide = table.groupBy("token").agg(one(1).alias("t"), one(0).alias("c"))
    wide = durable(wide, "tokens")
    totals = wide.agg(F.sum("t").alias("t"), F.sum("c").alias("c")).first()
    model = Model()
    if not totals.t:
        n = chosen.count()
        return Model(bias=-math.log(n + 1) if n else 0.0)
    delta, ratio = log_odds(F.col("t"), F.col("c"), totals.t, totals.c or 0)
    # Every token is tested; those that pass stand in the sample's toxic texts, so the sample bounds them.
    found = wide.select("token", "c", delta.alias("delta"), ratio.alias("ratio")).where((F.col("delta") > 0) & (F.col("ratio") >= z_least**2)).collect()
    model.lexicon = {bytes(r.token): r.delta for r in found}
    model.rate = _solve_rate([r.delta - model.drift for r in found], [(r.c + 0.5) / ((totals.c or 0) + 1) for r in found], model.drift)
    # Segments of clean texts arise at K a token: the likeliest K, given the rate, is their number over the tokens read.
    calm = lessons.where("label = 0").select(_segment_counts(docs.sparkSession, model)("text").alias("s")).agg(F.sum("s.found").alias("found"), F.sum("s.words").alias("words")).first()
    model.k = min(1.0, ((calm.found or 0) + 0.5) / ((calm.words or 0) + 1))
    seen = lessons.select("label", evidence_column(docs.sparkSession, model)("text").alias("e")).select("label", "e.*").collect()
    x = np.array([_features(r.total, r.best) for r in seen])
    w = _logistic(x, np.array([float(r.label > 0) for r in seen]))
    model.bias, model.slope = float(w[0]), (float(w[1]), float(w[2]))
    return model


def _segment_counts(spark, model: Model):
    shared = spark.sparkContext.broadcast(model)

    @F.arrow_udf("struct<found: bigint, words: bigint>")
    def count(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            rows = [scan(shared.value, x.as_py()) for x in texts]
            yield pa.StructArray.from_arrays([pa.array([len(s) for s, _ in rows], pa.int64()), pa.array([n for _, n in rows], pa.int64())], names=["found", "words"])

    return count


def evidence_column(spark, model: Model):
    shared = spark.sparkContext.broadcast(model)

    @F.arrow_udf("struct<total: double, best: double>")
    def measure(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        own = shared.value
        for texts in batches:
            rows = [evidence(own, x.as_py()) for x in texts]
            yield pa.StructArray.from_arrays([pa.array([r[i] for r in rows], pa.float64()) for i in (0, 1)], names=["total", "best"])

    return measure


def toxicity_scores(docs: DataFrame, labels: DataFrame, threshold: float = 0.7, rows: int = 6000) -> DataFrame:
    """(doc_id, held_out, score, predicted) for each row of docs."""
    model = train(docs, labels, rows)
    logit = F.lit(model.bias) + model.slope[0] * F.log1p("total") + model.slope[1] * F.log1p("best")
    return (
        docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), evidence_column(docs.sparkSession, model)(utf8()).alias("e"))
        .select("doc_id", "held_out", "e.*")
        .select("doc_id", "held_out", (1 / (1 + F.exp(-logit))).alias("score"))
        .withColumn("predicted", (F.col("score") >= threshold).cast("int"))
    )


def toxic_passages(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, first, last, score, e_value): every segment with E < 1, token positions inclusive."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf("array<struct<first: int, last: int, score: double, e_value: double>>")
    def find(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        kind = pa.list_(pa.struct([("first", pa.int32()), ("last", pa.int32()), ("score", pa.float64()), ("e_value", pa.float64())]))
        own = shared.value
        for texts in batches:
            out = []
            for x in texts:
                found, n = scan(own, x.as_py())
                rows = [(a, b, s, own.k * n * math.exp(-own.rate * s)) for a, b, s in found]
                out.append([dict(zip(("first", "last", "score", "e_value"), r, strict=True)) for r in rows if r[3] < 1])
            yield pa.array(out, kind)

    return docs.select("doc_id", F.explode(find(utf8())).alias("s")).select("doc_id", "s.*")
