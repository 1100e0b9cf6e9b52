"""Nearest neighbours with a hash-prefix forest (LSH Forest; Bawa, Condie and Ganesan, 2005).

Each of `trees` trees gives a vector a string of 64 bits, the sides of random hyperplanes it lies on. A tree is the array
of its strings in order: a prefix is a range found by two binary searches. The hyperplanes come from a seed; vectors are
centred on the mean of a bounded sample (SAMPLE rows).

The index is written once: rows are dealt into chunks of at most `chunk`, and a chunk holds its ids, its vectors and, tree
by tree, its strings in order and the rows they belong to. A query descends in every tree of a chunk to its longest match
and ascends in all trees together, level by level and tree by tree on the last level, until the ranges hold `enough`
times the chunk's rows; so how far it matches varies with the data around it. Queries are searched in blocks of about
`block`, one block after the other: a block is all that the driver and a broadcast hold at a time. A task keeps the k best
ids of each query over all its chunks and returns k rows a query at its end. Distances are taken by matrix product to
choose rows, then exactly, by differences in double precision, for every row not farther than the k-th.

Embeddings with weak neighbours (here the 10 nearest have a cosine near 0.4) need many candidates for a recall of 0.9:
`enough` = 1.5 makes ranges that overlap to about three quarters of the rows, so the work grows with queries times rows. Vectors
with nearer neighbours do with less.

Edge cases: vectors that are null, zero, or hold null or non-finite parts take no part, nor do those whose length is
not the most frequent one, nor rows without an id; equal vectors tie by id; repeated rows are one row, and of an id's
different rows the nearest counts; with fewer than k candidates all are returned; an empty table gives an empty table;
columns of embeddings may have any names beside vec_id and embedding.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import durable, give_back, shared_dir

TREES, ENOUGH = 24, 1.5
#: Rows of a chunk, queries of a block, queries whose distances to a chunk are held at once, rows the mean is taken of.
CHUNK, BLOCK, LOT, SAMPLE = 8192, 2048, 256, 4096
BITS = 64


class Forest:
    """Hyperplanes of all trees. Strings are unsigned integers of 64 bits, first bit highest."""

    def __init__(self, mean: np.ndarray, trees: int, seed: int = 42):
        self.mean, self.trees = mean, trees
        self.planes = np.random.default_rng(seed).normal(size=(len(mean), trees * BITS))

    def strings(self, x: np.ndarray) -> np.ndarray:
        """(trees, rows) strings."""
        sides = ((x - self.mean) @ self.planes > 0).reshape(len(x), self.trees, BITS)
        return np.packbits(sides, axis=2).view(">u8").reshape(len(x), self.trees).T.astype(np.uint64)


def ranges(tree: np.ndarray, strings: np.ndarray, level: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last place (exclusive) in a sorted tree of the strings that share `level` leading bits with each query's."""
    rest = np.where(level > 0, np.uint64(0xFFFFFFFFFFFFFFFF) >> np.minimum(level, BITS - 1).astype(np.uint64), np.uint64(0xFFFFFFFFFFFFFFFF))
    rest = np.where(level >= BITS, np.uint64(0), rest)
    return np.searchsorted(tree, strings & ~rest, "left"), np.searchsorted(tree, strings | rest, "right")


def ascend(sorted_trees: np.ndarray, strings: np.ndarray, enough: float, least: int) -> tuple[np.ndarray, np.ndarray]:
    """(trees, queries) first and last places: the deepest level on which all trees together hold `enough` rows, with the
    trees that are not needed left one level deeper. One tree must hold `least` rows."""
    trees, queries = strings.shape

    def held(level: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        found = [ranges(sorted_trees[t], strings[t], level) for t in range(trees)]
        return np.stack([a for a, _ in found]), np.stack([b for _, b in found])

    low, high = np.zeros(queries, np.int64), np.full(queries, BITS + 1)  # level `low` holds enough, `high` does not
    while (high - low > 1).any():
        mid = (low + high) // 2
        a, b = held(mid)
        full = ((b - a).sum(axis=0) >= enough) & ((b - a).max(axis=0) >= least)
        low, high = np.where(full, mid, low), np.where(full, high, np.maximum(mid, low + 1))
    a, b = held(low)
    deep_a, deep_b = held(np.minimum(low + 1, BITS))
    gained = (deep_b - deep_a).sum(axis=0) + np.cumsum((b - a) - (deep_b - deep_a), axis=0)
    # A tree goes up if those before it do not hold enough yet, or if it is the largest and none other holds `least`.
    up = np.vstack([np.ones((1, queries), bool), gained[:-1] < enough])
    largest = (b - a).argmax(axis=0)
    up[largest, np.arange(queries)] |= (np.where(up, b - a, deep_b - deep_a)).max(axis=0) < least
    return np.where(up, a, deep_a), np.where(up, b, deep_b)


def _matrix(column: pa.Array) -> np.ndarray:
    return np.asarray(column.flatten(), np.float64).reshape(len(column), -1)


def nearest(ids: np.ndarray, x: np.ndarray, q: np.ndarray, own: int, k: int, far: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """The k ids nearest to q, ties to smaller ids, without id `own`; exact distances, of an id's rows the least.

    far: squared distances by matrix product, if they are known."""
    norms = (x * x).sum(axis=1)
    size = float(q @ q)
    far = norms - 2 * (x @ q) + size if far is None else far.copy()
    far[ids == own] = np.inf
    if len(far) > k:
        least = far
        if len(np.unique(ids)) < len(ids):
            _, place = np.unique(ids, return_inverse=True)
            least = np.full(place.max() + 1, np.inf)
            np.minimum.at(least, place, far)
        bound = np.partition(least, k - 1)[k - 1] if len(least) > k else np.inf
        slack = 1e-9 * (1 + size + norms)  # beyond what the product's rounding can be
        at = np.flatnonzero(far - slack <= bound + 1e-9 * (1 + size + (norms[np.argmin(np.abs(far - bound))] if np.isfinite(bound) else 0)))
    else:
        at = np.arange(len(far))
    at = at[ids[at] != own]
    score = np.sqrt(((x[at] - q) ** 2).sum(axis=1))
    return best(ids[at], score, k)


def best(ids: np.ndarray, score: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k different ids of least score, ties to smaller ids."""
    order = np.lexsort((ids, score))
    _, first = np.unique(ids[order], return_index=True)
    order = order[np.sort(first)[:k]]
    return ids[order], score[order]


def vectors(embeddings: DataFrame) -> DataFrame:
    """(vec_id, v): one row for each different row that takes part."""
    v = F.col("embedding").cast("array<double>")
    finite = F.forall(v, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    fine = finite & F.exists(v, lambda c: c != 0)
    named = embeddings.where(F.col("vec_id").isNotNull()).select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("v"))
    return named.where(F.coalesce(fine, F.lit(False))).distinct()


INDEX = "ids binary, x binary, strings binary, places binary"


def build(data: DataFrame, forest, chunk: int = CHUNK) -> DataFrame:
    """The written index: a row a chunk. forest: a broadcast Forest."""

    def chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, rows = [], 0

        def close(held: list) -> pa.RecordBatch:
            ids, x = np.concatenate([i for i, _ in held]), np.concatenate([x for _, x in held])
            strings = forest.value.strings(x)
            places = np.argsort(strings, axis=1, kind="stable")
            parts = [ids.astype("<i8"), x.astype("<f8"), np.take_along_axis(strings, places, axis=1).astype("<u8"), places.astype("<i4")]
            return pa.RecordBatch.from_arrays([pa.array([p.tobytes()], pa.binary()) for p in parts], names=["ids", "x", "strings", "places"])

        for batch in batches:
            ids, x = np.asarray(batch.column("vec_id")), _matrix(batch.column("v"))
            at = 0
            while at < len(ids):
                take = min(chunk - rows, len(ids) - at)
                held.append((ids[at : at + take], x[at : at + take]))
                rows, at = rows + take, at + take
                if rows == chunk:
                    yield close(held)
                    held, rows = [], 0
        if rows:
            yield close(held)
        held = batch = None
        give_back()

    return durable(data.select("vec_id", "v").mapInArrow(chunks, INDEX), "index")


def _visit(forest, lot, enough: float, k: int):
    def visit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked, q, strings = lot.value
        found: list[tuple[np.ndarray, np.ndarray]] = [(np.zeros(0, np.int64), np.zeros(0))] * len(asked)
        for batch in batches:
            for row in range(batch.num_rows):
                ids, x, trees, places = (np.frombuffer(batch.column(c)[row].as_py(), t) for c, t in enumerate(("<i8", "<f8", "<u8", "<i4")))
                n = len(ids)
                x, trees, places = x.reshape(n, -1), trees.reshape(-1, n), places.reshape(-1, n)
                norms = (x * x).sum(axis=1)
                for lo in range(0, len(asked), LOT):
                    mine = slice(lo, min(lo + LOT, len(asked)))
                    a, b = ascend(trees, strings[:, mine], enough * n + len(trees), min(k + 1, n))  # a query's own row does not count
                    far = norms + (q[mine] ** 2).sum(axis=1)[:, None] - 2 * (q[mine] @ x.T)
                    for i in range(len(far)):
                        marked = np.zeros(n, bool)
                        for t in range(len(trees)):
                            marked[places[t, a[t, i] : b[t, i]]] = True
                        at = np.flatnonzero(marked)
                        near, score = nearest(ids[at], x[at], q[lo + i], asked[lo + i], k, far[i, at])
                        before = found[lo + i]
                        found[lo + i] = best(np.concatenate([before[0], near]), np.concatenate([before[1], score]), k)
        sizes = [len(i) for i, _ in found]
        if sum(sizes):
            out = [np.repeat(asked, sizes), np.concatenate([i for i, _ in found]), np.concatenate([s for _, s in found])]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in out], names=["query_id", "vec_id", "score"])
        found = batch = None
        give_back()

    return visit


def search(embeddings: DataFrame, every: int = 100, k: int = 10, trees: int = TREES, enough: float = ENOUGH, block: int = BLOCK, chunk: int = CHUNK) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest found for every row whose vec_id is divisible by `every`."""
    spark = embeddings.sparkSession
    schema = "query_id bigint, rank int, vec_id bigint, score double"
    held = durable(vectors(embeddings), "vectors")
    lengths = held.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").limit(1).collect()
    if not lengths:
        return spark.createDataFrame([], schema)
    data = held.where(F.size("v") == lengths[0].n)
    sample = np.array([r.v for r in data.orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE).collect()])
    forest = Forest(sample.mean(axis=0), trees)
    shared = spark.sparkContext.broadcast(forest)  # dimensions x trees x 64 numbers
    index = build(data, shared, chunk)
    asked = durable(data.where(F.col("vec_id") % every == 0), "queries")
    blocks = max(1, -(-asked.count() // block))
    order = W.partitionBy("query_id").orderBy("score", "vec_id")
    path = f"{shared_dir(spark)}/tempora/{spark.sparkContext.applicationId}/neighbours-{uuid.uuid4().hex}"
    for b in range(blocks):
        got = asked.where(F.pmod(F.xxhash64("vec_id"), F.lit(blocks)) == b).collect()  # about `block` queries
        ids, q = np.array([r.vec_id for r in got], np.int64), np.array([r.v for r in got], np.float64).reshape(len(got), -1)
        if len(got):
            lot = spark.sparkContext.broadcast((ids, q, forest.strings(q)))
            found = index.mapInArrow(_visit(shared, lot, enough, k), "query_id bigint, vec_id bigint, score double")
            least = found.groupBy("query_id", "vec_id").agg(F.min("score").alias("score")).withColumn("rank", F.row_number().over(order))
            least.where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score").write.mode("append").parquet(path)
            lot.destroy()
    if not asked.limit(1).count():
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(path)


def brute_force(embeddings: DataFrame, every: int = 100, k: int = 10) -> DataFrame:
    """What search() gives when every row is a candidate; for measuring recall."""
    return search(embeddings, every, k, enough=float("inf"))
