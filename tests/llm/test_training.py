"""The classifiers' training and scores against second versions written plainly from their definitions."""

import itertools
import math
import random
import re
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from tempora.llm import quality, toxicity
from tempora.llm.common import sample_labels


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text)


@pytest.fixture(scope="module")
def corpus(spark):
    """Sixty texts whose labels follow some of their words, with repeats, odd marks and an empty one."""
    rnd = random.Random(11)
    calm, harsh = "the river Runs past 12 old mills, and nobody minds it much".split() + [f"word{n}" for n in range(200)], "you awful rotten Fool! shut up".split()
    data = []
    for i in range(60):
        toxic = i % 3 == 0
        words = [rnd.choice(calm) for _ in range(rnd.randrange(20, 60))]
        if toxic:
            at = rnd.randrange(len(words))
            words[at:at] = [rnd.choice(x) for _ in range(12) for x in (calm, harsh)]
        data.append((i, " ".join(words) if i != 7 else "", int(not toxic), int(toxic)))
    docs = spark.createDataFrame([(i, t) for i, t, _, _ in data], "doc_id bigint, text string")
    labels = spark.createDataFrame([(i, q, x) for i, _, q, x in data], "doc_id bigint, quality int, toxic int")
    return {i: t for i, t, _, _ in data}, docs, labels


# --- quality: features as a dictionary, one weight at a time ---


def slow_features(text):
    def shape(w):
        kinds = ["A" if "A" <= c <= "Z" else "a" if "a" <= c <= "z" or c > "\x7f" else "9" if "0" <= c <= "9" else c for c in w]
        return "".join(c for c, _ in itertools.groupby(kinds))

    crc = lambda s: zlib.crc32(s.encode())
    words = text.split()
    w, s = [crc(lower(x)) for x in words], [crc(shape(x)) for x in words]
    grams = [x + 2**33 for x in w] + [x + 2 * 2**33 for x in s]
    for i in range(len(words) - 1):
        grams += [31 * w[i] + w[i + 1] + 3 * 2**40, 37 * s[i] + 2 * s[i + 1] + (w[i] == w[i + 1]) + 5 * 2**40]
    counts = defaultdict(int)
    for g in grams:
        counts[(g * 0x9E3779B97F4A7C15 % 2**64) >> (64 - quality.BITS)] += 1
    return {k: quality.SCALE * n / len(grams) for k, n in counts.items()} | {"bias": 1.0}


def slow_leader(lessons, alpha=0.6, beta=1.0, l1=0.02, l2=0.1):
    z, n = defaultdict(float), defaultdict(float)

    def weight(k):
        if abs(z[k]) <= l1:
            return 0.0
        return -(z[k] - math.copysign(l1, z[k])) / ((beta + math.sqrt(n[k])) / alpha + l2)

    for x, y in lessons:
        p = 1 / (1 + math.exp(-sum(weight(k) * v for k, v in x.items())))
        step = {k: ((p - y) * v, weight(k)) for k, v in x.items()}
        for k, (g, w) in step.items():
            z[k] += g - (math.sqrt(n[k] + g * g) - math.sqrt(n[k])) / alpha * w
            n[k] += g * g
    return weight


def test_quality_against_one_weight_at_a_time(corpus):
    texts, docs, labels = corpus
    order = sample_labels(labels, "quality", lambda c: ~quality.held_out(c), 6000).orderBy("order", "doc_id").collect()
    assert {r.doc_id for r in order} == {i for i in texts if zlib.crc32(str(i).encode()) % 5}
    weight = slow_leader([(slow_features(texts[r.doc_id]), r.label) for _ in range(3) for r in order])
    for r in quality.quality_scores(docs, labels).collect():
        expected = 1 / (1 + math.exp(-sum(weight(k) * v for k, v in slow_features(texts[r.doc_id]).items())))
        assert r.score == pytest.approx(expected, abs=1e-5), r.doc_id
        assert r.predicted == (expected >= 0.3)


# --- toxicity: counts as sets, every segment by brute force, the fit by steps down its gradient ---


def slow_model(texts, truth):
    words = {i: re.findall(r"[0-9a-z\x80-\U0010ffff]+", lower(t)) for i, t in texts.items()}
    lefts = {y: {(w, b) for i, ws in words.items() if truth.get(i) == y for w, b in zip(ws, ["", *ws], strict=False)} for y in (0, 1)}
    total = {y: len(lefts[y]) for y in (0, 1)}
    count = {y: defaultdict(int) for y in (0, 1)}
    for y in (0, 1):
        for w, _ in lefts[y]:
            count[y][w] += 1
    lexicon = {}
    for w in count[1]:
        t, c = count[1][w], count[0][w]
        alpha = 500 * (t + c) / (total[0] + total[1])
        odds = [math.log((k + alpha) / (n + 500 - k - alpha)) for k, n in ((t, total[1]), (c, total[0]))]
        ratio = 2 * sum(k * math.log(k / ((t + c) * n / (total[0] + total[1]))) for k, n in ((t, total[1]), (c, total[0])) if k)
        if odds[0] > odds[1] and ratio >= 16:
            lexicon[w] = odds[0] - odds[1]
    return words, count, total, lexicon


def slow_segments(values):
    """Maximal segments: the best one, first and shortest of equals, then those to its left and to its right."""
    best = max(((sum(values[a:b]), -a, a - b) for a in range(len(values)) for b in range(a + 1, len(values) + 1)), default=(0, 0, 0))
    if best[0] <= 1e-12:
        return []
    a, b = -best[1], -best[1] - best[2]
    return slow_segments(values[:a]) + [best[0]] + slow_segments(values[b:])


def test_toxicity_against_a_plain_version(corpus):
    texts, docs, labels = corpus
    truth = {i: int(i % 3 == 0) for i in texts if zlib.crc32(str(i).encode()) % 3 != 1}
    words, count, total, lexicon = slow_model(texts, truth)
    model = toxicity.train(docs, labels)
    assert len(lexicon) >= 3 and {k.decode(): pytest.approx(v) for k, v in model.lexicon.items()} == lexicon

    shares = {w: (count[0][w] + 0.5) / (total[0] + 1) for w in lexicon}
    drift, x = model.drift, model.rate
    value = sum(shares[w] * math.exp(x * (s - drift)) for w, s in lexicon.items()) + (1 - sum(shares.values())) * math.exp(-x * drift)
    assert x in (0.05, 5.0) or value == pytest.approx(1.0, abs=1e-6)

    scored = {i: [lexicon.get(w, 0.0) - drift for w in ws] for i, ws in words.items()}
    found = {i: slow_segments(v) for i, v in scored.items()}
    clean = [i for i, y in truth.items() if y == 0]
    assert model.k == pytest.approx(min(1.0, (sum(len(found[i]) for i in clean) + 0.5) / (sum(len(words[i]) for i in clean) + 1)))

    def evidence(i):
        gains = [g for g in (x * s - math.log(model.k * max(1, len(words[i]))) for s in found[i]) if g > 0]
        return math.log1p(sum(gains)), math.log1p(max(gains, default=0.0))

    def chance(i):
        a, b = evidence(i)
        return 1 / (1 + math.exp(-(model.bias + model.slope[0] * a + model.slope[1] * b)))

    # The fit: at the optimum of the ridge-penalised likelihood its gradient is nought.
    at = {i: (1.0, *evidence(i)) for i in truth}
    for j, w in enumerate((model.bias, *model.slope)):
        assert sum((chance(i) - truth[i]) * at[i][j] for i in truth) + 1e-2 * w == pytest.approx(0, abs=1e-3)
    for r in toxicity.toxicity_scores(docs, labels).collect():
        assert r.score == pytest.approx(chance(r.doc_id), abs=1e-6) and r.predicted == (r.score >= 0.7)
    assert docs.where(F.col("text") == "").count() == 1
