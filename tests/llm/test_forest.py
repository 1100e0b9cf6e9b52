"""Nearest neighbours where rows or ids repeat."""

import numpy as np

from tempora.llm import forest


def test_a_row_repeated_50_times_takes_one_rank(spark):
    rng = np.random.default_rng(8)
    x = rng.normal(size=(60, 8))
    x[7] = x[0] + 0.001
    data = [(i, v.tolist()) for i, v in enumerate(x)] + [(7, x[7].tolist())] * 50
    df = spark.createDataFrame(data, "vec_id bigint, embedding array<double>").coalesce(1)
    d = np.sqrt(((x - x[0]) ** 2).sum(axis=1))
    want = [int(i) for i in np.argsort(d) if i][:10]
    for got in (forest.brute_force(df, 100, 10), forest.search(df, 100, 10)):
        rows = sorted(got.collect(), key=lambda r: r.rank)
        assert [r.rank for r in rows] == list(range(1, 11)) and rows[0].vec_id == 7
    assert [r.vec_id for r in sorted(forest.brute_force(df, 100, 10).collect(), key=lambda r: r.rank)] == want


def test_nearest_gives_k_ids():
    x = np.array([[1.0 + i / 1000, 0.0] for i in range(40)] + [[2.0, 0.0], [3.0, 0.0], [0.0, 0.0]])
    ids = np.array([1] * 40 + [2, 3, 0])
    near, score = forest.nearest(ids, x, np.zeros(2), 0, 3)
    assert near.tolist() == [1, 2, 3] and score.tolist() == [1.0, 2.0, 3.0]


def test_ascent_is_the_deepest_level_that_holds_enough():
    rng = np.random.default_rng(5)
    rows = rng.integers(0, 1 << 63, (3, 200), np.uint64) * np.uint64(2)
    rows[:, :40] = rows[:, :1]
    strings = rows[:, [0, 50, 60]]
    trees = np.sort(rows, axis=1)
    for enough, least in ((1, 1), (30, 11), (150, 11), (599, 1), (10_000, 1)):
        a, b = forest.ascend(trees, strings, enough, least)
        for q in range(3):
            same = np.array([[64 - int(x ^ strings[t, q]).bit_length() for x in trees[t].tolist()] for t in range(3)])
            whole = lambda level: (same >= level).sum(axis=1)
            level = max([v for v in range(65) if whole(v).sum() >= enough and whole(v).max() >= least], default=0)
            got = b[:, q] - a[:, q]
            deep = whole(level + 1) if level < 64 else whole(level)
            assert all(g in (w, d) for g, w, d in zip(got, whole(level), deep, strict=True))
            assert got.max() >= min(least, 200) and (got.sum() >= enough or level == 0)
            for t in range(3):
                assert (same[t, a[t, q] : b[t, q]] >= level).all()


def test_far_rows_of_great_length_are_not_lost():
    x = np.array([[1e8, 0.0], [1e8, 1e-3], [1e8, 2e-3], [-1e8, 0.0]])
    near, score = forest.nearest(np.array([4, 3, 2, 1]), x, np.array([1e8, 1.1e-3]), -1, 1)
    assert near.tolist() == [3]
