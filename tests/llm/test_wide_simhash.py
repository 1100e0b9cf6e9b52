"""Near-dedup's proposals: SimHash, against majorities counted bit by bit and all pairs of fingerprints."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tempora.llm import shingles
from tempora.llm.common import durable
from tests.llm.test_shingles import slow_set

M = (1 << 64) - 1


def slow_mix(h, j):
    z = (h + (j + 1) * 0x9E3779B97F4A7C15) & M
    z = (z ^ z >> 30) * 0xBF58476D1CE4E5B9 & M
    z = (z ^ z >> 27) * 0x94D049BB133111EB & M
    return z ^ z >> 31


def slow_print(hashes):
    """832 bits, lowest first, of a list of hashes."""
    out = []
    for j in range(13):
        mixed = [slow_mix(h, j) for h in sorted(hashes)]
        for i in range(64):
            ones = sum(z >> i & 1 for z in mixed)
            out.append(int(2 * ones > len(mixed) or 2 * ones == len(mixed) and mixed[0] >> i & 1))
    return out


def components(n, pairs):
    root = list(range(n))
    for a, b in pairs:
        a, b = sorted((root[a], root[b]))
        root = [a if r == b else r for r in root]
    return root


def texts(rng):
    """Drifting copies on both sides of the bound, and texts of four shingles out of another's five."""
    out = []
    for _ in range(15):
        words = [f"w{x}" for x in rng.integers(0, 5000, 90)]
        for _ in range(6):
            out.append(" ".join(words))
            for at in rng.integers(0, 90, rng.integers(1, 4)):
                words[at] = f"w{rng.integers(0, 5000)}"
    for _ in range(60):
        words = [f"w{x}" for x in rng.integers(0, 5000, 9)]
        out += [" ".join(words), " ".join(words[:8])]
    return out


@pytest.mark.parametrize("n", [1, 2, 4, 7, 255, 256, 600])
def test_fingerprint_is_the_bitwise_majority(n):
    hashes = np.unique(np.random.default_rng(n).integers(0, 1 << 64, n, np.uint64))
    got = np.unpackbits(np.frombuffer(shingles.wide_fingerprint(hashes), np.uint8), bitorder="little")
    assert got.tolist() == slow_print(hashes.tolist())


@pytest.mark.parametrize("bucket", [shingles.BUCKET, 2])
def test_candidates_are_near_fingerprints_that_share_a_band(spark, bucket):
    data = texts(np.random.default_rng(8))
    df = spark.createDataFrame(list(enumerate(data)), "node bigint, text string").repartition(3)
    sets = durable(df.select("node", shingles.sketch_column(5, 0.8)(F.col("text").cast("binary")).alias("k")).select("node", "k.n", "k.prints"), "sets")
    got = {r.node: r.root for r in shingles.candidates(sets, 0.8, bucket).collect()}

    hashes = [shingles.shingle_set(t.encode(), 5).tolist() for t in data]
    # (node, fingerprint, own): a set of five is also looked for without one shingle, in the first band
    prints = [(i, slow_print(h), True) for i, h in enumerate(hashes)]
    prints += [(i, slow_print(h[:k] + h[k + 1 :]), False) for i, h in enumerate(hashes) if len(h) == 5 for k in range(5)]
    bits = np.array([p for _, p, _ in prints])
    pairs = []
    for x, (i, _, own) in enumerate(prints):
        banded = (bits[:x, 192:] == bits[x, 192:]).reshape(x, 64, 10).all(axis=2)
        both = np.array([own and other for _, _, other in prints[:x]], bool)
        meet = banded[:, 0] | banded.any(axis=1) & both
        near = (bits[:x, :192] != bits[x, :192]).sum(axis=1) <= 54
        pairs += [(i, prints[y][0]) for y in np.flatnonzero(meet & near)]
    want = components(len(data), pairs)
    assert [want[i] == want[j] for i in range(len(data)) for j in range(i)] == [got.get(i, i) == got.get(j, j) for i in range(len(data)) for j in range(i)]

    own = [slow_set(t) for t in data]
    alike = [(i, j) for i in range(len(data)) for j in range(i) if 5 * len(own[i] & own[j]) >= 4 * len(own[i] | own[j])]
    assert len(alike) > 90 and all(want[i] == want[j] for i, j in alike)
