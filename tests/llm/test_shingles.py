"""Near-dedup by shingle similarity against brute force."""

from collections import Counter, defaultdict

import corpus_pipeline
import numpy as np

from tempora.llm import shingles

SF = "/root/testdata/sf0.01"


def slow_set(text):
    words = "".join(c.lower() if c.isascii() else c for c in text or "").encode().split()
    return {b" ".join(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def slow_kept(sets):
    """The least key of each component of a Jaccard similarity of 0.8 or more."""
    holders, common, root = defaultdict(list), Counter(), {i: i for i in sets}
    for i in sorted(sets):
        for x in sets[i] or {None}:
            holders[x].append(i)
    for h in holders.values():
        common.update((a, b) for k, b in enumerate(h) for a in h[:k])

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for (a, b), n in common.items():
        if not sets[a] or 5 * n >= 4 * (len(sets[a]) + len(sets[b]) - n):
            a, b = sorted((top(a), top(b)))
            root[b] = a
    return {i for i in sets if root[i] == i}


def test_the_stage_keeps_one_of_each_group_of_similarity_08(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = [r.doc_id for r in corpus_pipeline.near_dedup_stage(spark, docs, SF).collect()]
    assert len(got) == len(set(got)) and set(got) == slow_kept({r.doc_id: slow_set(r.text) for r in docs.collect()})


def test_edits_chains_and_bounds(spark):
    rng, data = np.random.default_rng(4), []
    for _ in range(40):
        words = [f"w{x}" for x in rng.integers(0, 5000, 120)]
        for _ in range(10):  # a chain of drifting copies, around the bound on both sides
            data.append(" ".join(words))
            for at in rng.integers(0, 120, rng.integers(1, 5)):
                words[at] = f"w{rng.integers(0, 5000)}"
    data += ["", None, " ", "a b", "A  b", "a b c d e", "a b c d e f"]
    order = rng.permutation(len(data))
    df = spark.createDataFrame([(int(i), data[i]) for i in order], "doc_id bigint, text string")
    want = slow_kept({i: slow_set(t) for i, t in enumerate(data)})
    assert 40 < len(want) < 400
    assert {r.doc_id for r in shingles.keep_one(df).collect()} == want
