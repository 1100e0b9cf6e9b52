"""Each operator against brute force, an exact law or held-out accuracy, and on odd and empty tables."""

import hashlib
import itertools
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from tempora.llm import decontam, forest, lines, mixing, pii, quality, sharding, simhash, tokens, toxicity

SF = "/root/testdata/sf0.001"


def docs_of(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


def by_id(df):
    return {r.doc_id: r for r in df.collect()}


# --- simhash ---


def slow_fingerprint(text, width):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: chr(ord(m[0]) + 32), text or ""))
    shingles = [" ".join(w[i : i + width]) for i in range(len(w) - width + 1)] or ([" ".join(w)] if w else [])
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << i for i in range(64) if 2 * sum(x >> i & 1 for x in h) > len(h))


def slow_components(fps: dict, radius):
    ids, root = sorted(fps), {i: i for i in fps}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in ids:
        for b in ids:
            if a < b and (fps[a] ^ fps[b]).bit_count() <= radius:
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {i: find(i) for i in ids}


def test_simhash_whole(spark):
    docs = docs_of(spark)
    got = by_id(simhash.near_duplicates(docs, 4, 4))
    fps = {r.doc_id: slow_fingerprint(r.text, 4) for r in docs.collect()}
    assert {i: r.fp & (1 << 64) - 1 for i, r in got.items()} == fps
    assert {i: r.component_id for i, r in got.items()} == slow_components(fps, 4)


def test_covering_masks_miss_nothing():
    rnd, masks = random.Random(1), simhash.covering_masks(4)
    assert len(masks) == 31
    for _ in range(2000):
        d = sum(1 << i for i in rnd.sample(range(64), rnd.randrange(5)))
        assert any(d & m == 0 for m in masks)


def test_links_chains_and_blocks(spark):
    rnd = random.Random(2)
    fps = set()
    for _ in range(6):
        x = rnd.getrandbits(64)
        for _ in range(40):
            fps.add(x)
            x ^= sum(1 << i for i in rnd.sample(range(64), rnd.choice([1, 3, 4, 7])))
    values = {i: x for i, x in enumerate(sorted(fps))}
    signed = {i: x - (1 << 64) if x >> 63 else x for i, x in values.items()}
    df = spark.createDataFrame([(i, s) for i, s in signed.items()], "i bigint, fp bigint")
    for block in (2, 7, 8192):
        roots = {r.node: r.root for r in simhash.components(simhash.links(df.select("fp"), 4, block)).collect()}
        expected = slow_components(values, 4)
        groups = {}
        for i, s in signed.items():
            groups.setdefault(roots.get(s, s), set()).add(i)
        assert sorted(map(sorted, groups.values())) == sorted(sorted(j for j in expected if expected[j] == r) for r in set(expected.values()))


def test_components_of_a_chain_and_a_star(spark):
    """A chain of ascending values takes few rounds, not one a node."""
    chain = [(i, i + 1) for i in range(100)]
    star = [(1000, 1000 + i) for i in range(1, 60)] + [(999, 1000)]
    got = {r.node: r.root for r in simhash.components(spark.createDataFrame(chain + star, "a long, b long")).collect()}
    assert set(got) == set(range(101)) | set(range(999, 1060))
    assert len({got[i] for i in range(101)}) == len({got[i] for i in range(999, 1060)}) == 1
    assert got[0] != got[999]


def test_simhash_odd(odd_docs, no_docs):
    got = simhash.near_duplicates(odd_docs).collect()
    assert len(got) == 8 and {r.component_id for r in got if r.fp == 0} == {1}
    kept = simhash.keep_one(odd_docs).collect()
    assert sorted(r.doc_id for r in kept if r.doc_id) == [1, 3, 5, 7] and len(kept) == 5
    assert simhash.near_duplicates(no_docs).count() == 0 and simhash.keep_one(no_docs).count() == 0


# --- nearest neighbours ---


def test_forest_recall_and_ties(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(900, 16))
    x[::7] = x[0]
    data = [(i, v.tolist()) for i, v in enumerate(x)] + [(5000, None), (5001, [0.0] * 16), (5002, [float("nan")] * 16), (5003, [1.0, None] * 8), (5004, [1.0] * 3), (None, [1.0] * 16), (7, x[7].tolist())]
    df = spark.createDataFrame(data, "vec_id bigint, embedding array<double>")
    got, exact = forest.search(df, 100, 10).collect(), {}
    for q in range(0, 900, 100):
        d = np.sqrt(((x - x[q]) ** 2).sum(axis=1))
        exact[q] = [(int(i), d[i]) for i in np.lexsort((np.arange(900), d)) if i != q][:10]
    hits = 0
    for q, best in exact.items():
        mine = sorted((r.rank, r.vec_id, r.score) for r in got if r.query_id == q)
        assert [r for r, _, _ in mine] == list(range(1, 11))
        hits += len({i for i, _ in best} & {i for _, i, _ in mine})
    assert hits / 90 >= 0.9
    assert [r.vec_id for r in sorted(got, key=lambda r: r.rank) if r.query_id == 0] == [i for i, _ in exact[0]]
    full = sorted((r.query_id, r.rank, r.vec_id) for r in forest.brute_force(df, 100, 10).collect())
    assert full == [(q, i + 1, v) for q, best in exact.items() for i, (v, _) in enumerate(best)]
    small = forest.search(df, 100, 10, block=3, chunk=100).collect()
    assert len(small) == 90
    assert forest.search(df.where("vec_id IN (0, 1, 2)"), 100, 10).count() == 2
    assert forest.search(df.where("vec_id < 0"), 100, 10).count() == 0


# --- tokens ---


def test_tokens(spark, odd_docs, no_docs):
    P = pytest.importorskip("public_tokenizers")
    import sentencepiece

    path = P.path("piece_bpe_32k.model")
    whole = sentencepiece.SentencePieceProcessor(model_file=path)
    for df in (docs_of(spark), odd_docs):
        texts = [(r.doc_id, r.text or "") for r in df.collect()]
        got = sorted((str(r.doc_id), r.n_bytes, r.n_tokens, r.over_limit) for r in tokens.token_counts(df, path).collect())
        assert got == sorted((str(i), len(t.encode()), n := len(whole.encode(t)), n > 4096) for i, t in texts)
    assert tokens.token_counts(no_docs, path).count() == 0
    counter, rnd = tokens.Counter(open(path, "rb").read()), random.Random(4)
    bits = ["a", " ", "  ", "\n", "the", "▁", "é", "\t", "\r", "日", ".", " The", "ing", "\x00", "<s>"]
    old, tokens.SEGMENT, tokens.SHORT, tokens.LOT = (tokens.SEGMENT, tokens.SHORT, tokens.LOT), 7, 3, 9
    try:
        for _ in range(1500):
            t = "".join(rnd.choice(bits) for _ in range(rnd.randrange(20)))
            assert counter.counts([t, None, t]) == [len(whole.encode(t)), 0, len(whole.encode(t))], repr(t)
    finally:
        tokens.SEGMENT, tokens.SHORT, tokens.LOT = old


# --- classifiers ---


def crc(i):
    return zlib.crc32(str(i).encode())


def test_quality_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    got = by_id(quality.quality_scores(docs, labels))
    truth = {r.doc_id: r.quality for r in labels.collect() if crc(r.doc_id) % 5 == 0}
    assert all(r.held_out == (crc(i) % 5 == 0) and 0 <= r.score <= 1 for i, r in got.items())
    assert np.mean([got[i].predicted == y for i, y in truth.items()]) > 0.93
    again = by_id(quality.quality_scores(docs, labels.where("doc_id % 2 >= 0").withColumn("quality", F.when(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(5)) == 0, 1 - F.col("quality")).otherwise(F.col("quality")))))
    assert all(abs(again[i].score - r.score) < 1e-9 for i, r in got.items())  # held-out labels teach nothing


def test_toxicity_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    got = by_id(toxicity.toxicity_scores(docs, labels))
    truth = {r.doc_id: r.toxic for r in labels.collect() if crc(r.doc_id) % 3 == 1}
    assert np.mean([got[i].predicted == y for i, y in truth.items()]) > 0.93
    assert not any(got[i].predicted for i, y in truth.items() if not y)


def slow_segments(values):
    """All maximal scoring segments by their recursive definition."""
    out = []

    def split(lo, hi):
        best = max(((sum(values[a:b]), a - b, a, b) for a in range(lo, hi) for b in range(a + 1, hi + 1)), default=(0, 0, 0, 0), key=lambda t: (t[0], t[1]))
        if best[0] > 1e-12:
            out.append((best[2], best[3] - 1, best[0]))
            split(lo, best[2])
            split(best[3], hi)

    split(0, len(values))
    return sorted(out)


def test_segments_are_maximal():
    rnd = random.Random(6)
    for _ in range(200):
        values = [rnd.choice([-1.0, -1.0, -1.0, 2.5, 4.2]) + rnd.random() / 50 if rnd.random() < 0.4 else -1.0 for _ in range(14)]
        hits = [(i, v) for i, v in enumerate(values) if v != -1.0]
        got = sorted(toxicity.segments(hits, 1.0))
        assert [g[:2] for g in got] == [s[:2] for s in slow_segments(values)]


def test_classifiers_odd(spark, odd_docs, no_docs, labels):
    for scores in (quality.quality_scores, toxicity.toxicity_scores):
        got = scores(odd_docs, labels).collect()
        assert len(got) == 8 and all(0 <= r.score <= 1 for r in got)
        assert len({r.score for r in got if r.doc_id in (1, 2, 6)}) == 1
        assert scores(no_docs, labels).count() == 0
        assert {r.score for r in scores(odd_docs, labels.limit(0)).collect()} == {0.5}
    assert quality.keep_good(odd_docs, labels).columns == odd_docs.columns
    model = toxicity.Model({b"bad": 4.0}, 0.25, 3.0)
    found = toxicity.toxic_passages(spark.createDataFrame([(1, "so Bad, bad and good " + "x " * 30 + "bad bad")], "doc_id bigint, text string"), model).collect()
    assert [(r.first, r.last) for r in found] == [(1, 2), (35, 36)]


# --- mixing ---


def slow_targets(sizes, weights=(5, 2, 1)):
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    w = {s: weights[i % 3] for i, s in enumerate(names)}
    left, open_, out = 1.5 * sum(sizes.values()), set(names), {}
    while open_:
        share = {s: left * w[s] / sum(w[x] for x in open_) for s in open_}
        over = [s for s in open_ if share[s] > 2 * sizes[s]]
        if not over:
            return out | share
        for s in over:
            out[s] = 2.0 * sizes[s]
            left -= out[s]
            open_.discard(s)
    return out


def test_mixing(spark, odd_docs, no_docs):
    for df in (docs_of(spark), odd_docs):
        got = mixing.mixture(df).collect()
        sizes = {}
        for r in got:
            sizes[r.source] = sizes.get(r.source, 0) + r.size
        goal = slow_targets(sizes)
        taken, most = {}, {}
        for r in got:
            assert r.source_size == sizes[r.source] and abs(r.target - goal[r.source]) < 1e-6 * max(1, goal[r.source]) and r.taken <= 2 * r.size
            taken[r.source] = taken.get(r.source, 0) + r.taken
            most[r.source] = max(most.get(r.source, 0), r.size * sum(x.doc_id == r.doc_id for x in got))
        assert all(abs(taken[s] - goal[s]) <= most[s] / 2 + 1e-6 for s in goal)
        mixed = mixing.mix(df)
        assert mixed.columns == df.columns and mixed.count() == sum(r.copies for r in got)
        assert sorted(map(str, mixing.mixture(df.repartition(5)).collect())) == sorted(map(str, got))
    assert mixing.mixture(no_docs).count() == 0 and mixing.mix(no_docs).count() == 0
    capped = spark.createDataFrame([(i, "w" if i % 2 else "", "en", "a", 0) for i in range(20)] + [(99, "w " * 1000, "en", "b", 0)], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    assert {r.copies for r in mixing.mixture(capped).collect() if r.source == "a"} == {2} and mixing.mix(capped).where("source = 'a'").count() == 40


def test_mixing_levels_agree_with_a_sort(spark):
    rnd = random.Random(8)
    df = spark.createDataFrame([(i, "w " * rnd.randrange(40), "en", rnd.choice("abcd"), 0) for i in range(3000)], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    got = mixing.mixture(df).collect()
    h = {i: int(hashlib.md5(str(i).encode()).hexdigest()[:15], 16) for i in range(3000)}
    for s in "abcd":
        own = sorted((r for r in got if r.source == s), key=lambda r: h[r.doc_id])
        base, before = int(own[0].target // own[0].source_size), 0
        budget = own[0].target - base * own[0].source_size
        for r in own:
            assert r.copies == base + (2 * before + r.size <= 2 * budget) or r.size == 0
            before += r.size


# --- sharding ---


def test_hilbert_curve_is_one(spark):
    bits = 3
    cells = spark.range(1 << 3 * bits).select(*[(F.shiftright("id", bits * k) % (1 << bits)).alias(f"x{k}") for k in range(3)])
    got = cells.select("*", sharding.hilbert_index([F.col(f"x{k}") for k in range(3)], bits).alias("i")).orderBy("i").collect()
    assert [r.i for r in got] == list(range(512))
    assert all(sum(abs(a[k] - b[k]) for k in range(3)) == 1 for a, b in zip(got, got[1:], strict=False))


def test_sharding(spark, odd_docs, no_docs):
    docs = docs_of(spark)
    copies = docs.where("doc_id < 20").withColumn("doc_id", F.col("doc_id") + 10_000).withColumn("source", F.lit("other"))
    for df in (docs.unionByName(copies), odd_docs):
        text = {r.doc_id: r.text or "" for r in df.collect()}
        got, n = sharding.shard_assignments(df).collect(), df.count()
        counts = [sum(r.shard == s for r in got) for s in range(40)]
        assert len(got) == n and max(counts) - min(counts) <= 1
        for s in range(40):
            assert sorted(r.slot for r in got if r.shard == s) == list(range(counts[s]))
        assert all(r.text_crc32 == zlib.crc32(text[r.doc_id].encode()) and r.size == len(text[r.doc_id].encode()) + 16 for r in got)
        place = {}
        for k, r in enumerate(sorted(got, key=lambda r: (r.shard, r.slot))):
            place.setdefault(text[r.doc_id], []).append(k)
        assert all(p[-1] - p[0] == len(p) - 1 for p in place.values())
        whole = sharding.shard_documents(df)
        assert whole.columns == [*df.columns, "__shard" if "shard" in df.columns else "shard", "slot"]
        by_shard = Counter(r[-2] for r in whole.collect())
        assert sum(by_shard.values()) == n and max(by_shard.values()) - min(by_shard[s] for s in range(40)) <= 1
    assert sharding.shard_assignments(no_docs).count() == 0 and sharding.shard_documents(no_docs).count() == 0


def test_shards_prune_in_every_dimension(spark, tmp_path):
    """Shards whose min and max admit a value, over all values of each dimension: fewer than after a plain sort."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").withColumn("size", sharding.sizes())

    def read(shards):
        by = {}
        for r in shards:
            by.setdefault(r[0], []).append(r[1:])
        total = 0
        for d in range(3):
            values = [r[d + 1] for r in shards]
            total += sum(sum(min(x[d] for x in s) <= v <= max(x[d] for x in s) for s in by.values()) for v in values) / len(values)
        return total

    got = [(r.shard, r.lang, r.source, r.size) for r in sharding.shard_documents(docs).collect()]
    plain = sorted(g[1:] for g in got)
    assert read(got) < 0.8 * read([(k * 40 // len(plain), *r) for k, r in enumerate(plain)])
    sharding.write_shards(docs, str(tmp_path / "shards"))
    again = spark.read.parquet(str(tmp_path / "shards"))
    assert again.count() == len(got) and sorted(again.select("shard").distinct().toPandas().shard) == list(range(40))


# --- line dedup ---


def slow_units(text, close=8, least=5, longest=32):
    """(start, end, words, lower-cased words) by the rules as the module states them, one word at a time."""
    text = text or ""
    w = [(m.start(), m.end(), m[0].lower()) for m in lines.WORD.finditer(text)]
    width = [1 if lines.DENSE.match(x) else 2 for _, _, x in w]
    opens = [i == 0 or "\n" in text[w[i - 1][1] : a] for i, (a, _, _) in enumerate(w)]
    mask = (1 << 64) - 1
    h = [xxhash.xxh3_64_intdigest(x) for _, _, x in w]
    at = list(itertools.accumulate(width))
    out, begin, keys = [], 0, []
    for i in range(len(w)):
        last = i + 1 == len(w) or opens[i + 1]
        key = ((h[i] * 0x9E3779B97F4A7C15 + (0 if opens[i] else h[i - 1]) & mask) * 0xD6E8FEB86659FD93 & mask) >> 2
        keys.append(-1 if last else (key if w[i][2][-1] in lines.STOPS else key | 1 << 62) | 1)

    def cut(i):
        if keys[i] == -1:
            return True
        near = [keys[k] for k in range(len(w)) if k != i and abs(at[k] - at[i]) <= close]
        return all(keys[i] < k for k in near) and at[i] > close  # a line's start is an end of the one before

    for i in range(len(w)):
        if cut(i):
            while begin <= i:
                stop = begin + longest if i + 1 - begin >= longest + least else i + 1
                if sum(width[begin:stop]) >= 2 * least:
                    out.append((w[begin][0], w[stop - 1][1], sum(width[begin:stop]) // 2, " ".join(x for _, _, x in w[begin:stop])))
                begin = stop
    return out


def slow_repeats(texts):
    """{id: [(start, end, id that keeps it)]} for texts by id, in order."""
    first, out = {}, {}
    for i in sorted(texts):
        own, runs = slow_units(texts[i]), []
        for place, (a, b, n, words) in enumerate(own):
            if words in first:
                if not runs or runs[-1][-1][0] != place - 1:
                    runs.append([])
                runs[-1].append((place, n, a, b, first[words]))
            else:
                first[words] = i
        gone = [x[2:] for r in runs if sum(x[1] for x in r) >= 20 or len(r) == len(own) for x in r]
        if gone:
            out[i] = gone
    return out


def test_lines(spark, odd_docs, no_docs):
    docs = docs_of(spark)
    text = {r.doc_id: r.text for r in docs.collect()}
    gone = slow_repeats(text)
    got = by_id(lines.repeated_units(docs))
    assert {i: [tuple(s) for s in r.removed] for i, r in got.items() if r.removed} == gone and len(got) == len(text)
    cut = by_id(lines.remove_repeats(docs))
    for i, t in text.items():
        for a, b, _ in reversed(gone.get(i, [])):
            t = t[:a] + t[b:]
        assert cut[i].text == t
    assert len(lines.repeated_units(odd_docs).collect()) == 8 and lines.repeated_units(no_docs).count() == 0
    twice = [r for r in lines.repeated_units(odd_docs).collect() if r.doc_id == 3]
    assert min(r.n_removed for r in twice) == 0 and max(r.n_removed for r in twice) == twice[0].n_units  # all of one, none of the other
    clash = docs.where("doc_id < 40").select(F.col("doc_id").cast("string").alias("doc_id"), "text", F.lit(1).alias("__removed"), F.lit(2).alias("__ROW"))
    assert lines.remove_repeats(clash).columns == ["doc_id", "text", "__removed", "__ROW", "___removed"] and lines.remove_repeats(clash).count() == 40
    assert lines.repeated_units(clash).count() == 40 and lines.remove_repeats(no_docs).count() == 0


def test_a_shared_passage_falls_into_step():
    passage = "Is there rain. Over all the hills and far away the river runs to the sea. Then. It turns again before the old mill by the bridge and stops."
    a = list(lines.units("alpha beta gamma. " + passage + " Some more."))
    b = list(lines.units("delta " + passage))
    assert len({x[-1] for x in a} & {x[-1] for x in b}) >= 1


# --- personal data ---

RULES = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def slow_base(text):
    out = []
    for kind, p in RULES.items():
        for m in re.finditer(p, text):
            d = re.sub("[^0-9]", "", m[0])
            if kind == "ip" and any(int(x) > 255 for x in m[0].split(".")):
                continue
            if kind == "card" and not (16 <= len(d) <= 19 and sum(int(c) if k % 2 == 0 else sum(divmod(2 * int(c), 10)) for k, c in enumerate(reversed(d))) % 10 == 0):
                continue
            if kind == "phone" and not 8 <= len(d) <= 15:
                continue
            out.append(f"{kind}:{m.start()}:{m.end()}")
    return ",".join(out)


def test_personal_data(spark, odd_docs, no_docs):
    rnd = random.Random(5)
    bits = ["a@b.c", "_d@e.f-g.h", "@", "1.2.3.4", "300.1.1.1", ".5", "4111111111111111", "4111 1111-1111 1111", "+1 (499) 555-6503", "+49 30 1234", "é😀", " ", "-", "x", "7", "(at)", "jo [at] mail.example.com", " (212) 555-0147 ", "00001.2.3.4", "+"]
    made = [(i, "".join(rnd.choice(bits) for _ in range(rnd.randrange(12))), "en", "s", 0) for i in range(400)]
    df = docs_of(spark).unionByName(spark.createDataFrame([(i + 10_000, *r) for i, *r in made], "doc_id bigint, text string, lang string, source string, n_chars bigint"))
    text = {r.doc_id: r.text for r in df.collect()}
    added = 0
    for i, r in by_id(pii.personal_data(df)).items():
        base = slow_base(text[i])
        assert r.base_sha256 == hashlib.sha256(base.encode()).hexdigest(), (text[i], base, r.spans)
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [base.count(f"{k}:") for k in RULES]
        assert set(base.split(",")) - {""} <= set(r.spans.split(","))
        added += len(set(r.spans.split(",")) - set(base.split(",")))
    assert added > 5
    assert len(pii.personal_data(odd_docs).collect()) == 8 and not pii.personal_data(no_docs).collect()


def test_redact(spark, odd_docs, no_docs):
    model = pii.Model([], {})
    df = spark.createDataFrame([(1, "to a@b.cd, 1.2.3.4 and on", "x"), (2, None, "y")], "doc_id bigint, text string, __masked string")
    got = by_id(pii.redact(df, model))
    assert got[1].text == "to " + "*" * 6 + ", " + "*" * 7 + " and on" and got[1]["__masked"] == "x" and got[2].text == ""
    assert pii.redact(odd_docs, model).columns == odd_docs.columns and pii.redact(odd_docs, model).count() == 8 and pii.redact(no_docs, model).count() == 0


def test_long_runs_cost_linear_time(spark):
    long = [(1, "a" * 200_000), (2, "1" * 200_000), (3, "1 " * 100_000), (4, "a." * 100_000 + "@"), (5, "x@" + "a." * 50_000 + "b"), (6, "+" + "1" * 100_000)]
    df = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in long], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    assert {i: r.n_email for i, r in by_id(pii.personal_data(df)).items()} == {1: 0, 2: 0, 3: 0, 4: 0, 5: 1, 6: 0}


def test_many_spans_cost_near_linear_time(spark):
    text = "12 x 1.2.3.4 a@b.c " * 30_000
    df = spark.createDataFrame([(1, text), (2, "a@b.c")], "doc_id bigint, text string")
    found = by_id(pii.personal_data(df))
    assert (found[1].n_ip, found[1].n_email, found[2].n_email) == (30_000, 30_000, 1)
    assert found[1].base_sha256 == hashlib.sha256(slow_base(text).encode()).hexdigest()


# --- decontamination ---


def slow_hits(text, items, window=8):
    split = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    w, hit, found = split(text), set(), set()
    for item, t in items:
        v = split(t)
        n = min(window, len(v))
        grams = {tuple(v[i : i + n]) for i in range(len(v) - n + 1)} if n else set()
        for i in range(len(w) - n + 1) if n else ():
            if tuple(w[i : i + n]) in grams:
                hit |= set(range(i, i + n))
                found.add(str(item))
    return len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest()


@pytest.mark.parametrize("part_bytes", [1 << 24, 300])
def test_decontamination(spark, odd_docs, no_docs, part_bytes):
    bench = [(1, "One two three four five six seven eight nine ten"), (2, "Short item"), (3, "x"), (4, None), (5, "..."), (10, "two three four five six seven eight nine"), (None, "one")]
    rnd = random.Random(3)
    vocab = "one two three four five six seven eight nine ten short item x ünï".split()
    made = [(i, " ".join(rnd.choice(vocab) for _ in range(rnd.randrange(30)))) for i in range(60)] + [(100, "so ONE, two three four; five six seven eight nine ten end"), (101, None)]
    b = spark.createDataFrame(bench, "item_id bigint, text string")
    d = spark.createDataFrame(made, "doc_id bigint, text string")
    got = by_id(decontam.contamination(d, b, part_bytes=part_bytes))
    items = [x for x in bench if x[0] is not None]
    for i, t in made:
        r = got[i]
        assert (r.n_words, r.n_hit, r.n_items, r.items_sha256) == slow_hits(t, items) and r.contaminated == (r.n_items >= 2)
    keep = decontam.keep_clean(odd_docs, b, part_bytes=part_bytes)
    assert keep.columns == odd_docs.columns and sorted(str(r.doc_id) for r in keep.collect()) == ["1", "2", "3", "3", "5", "6", "7", "None"]
    assert decontam.contamination(no_docs, b).count() == 0 and decontam.contamination(d, b.limit(0)).where("n_items > 0").count() == 0
