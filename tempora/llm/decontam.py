"""Benchmark decontamination by Wu-Manber multi-pattern search over words.

Patterns are the windows of the benchmark items. With m the window length and blocks of two words, a table gives for
each block that occurs in some pattern how far the search may move when the block ends the window under test; any
other block moves it m-1 words. Where the move is zero, the block's hash picks the patterns that end in it, and direct
comparison confirms. Items shorter than a window are patterns of their own length, one class of tables a length;
patterns of one word are looked up in a set.

Texts are only mapped, never shuffled. Patterns are broadcast in parts of at most `part_bytes` of item text (checked
by a sum before anything is collected); a larger benchmark is searched part by part, each pass adding its hits to a
written table, so memory stays bounded and no pattern is dropped.

Edge cases: null and word-less texts have no words and no hits; null and word-less items match nothing; items that
repeat an id are one item; null item ids are ignored; every row returns one row; clashing column names are untouched.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WORDS, durable, give_back, utf8

WINDOW = 8
#: Item text of one part: its tables take some hundred bytes a word in each worker.
PART_BYTES = 4 << 20


def words_of(text: bytes | None) -> list[bytes]:
    return (text or b"").translate(WORDS).split()


class Patterns:
    """Wu-Manber tables over word sequences of one length."""

    def __init__(self, length: int, patterns: dict[tuple[bytes, ...], list]):
        self.length, self.patterns = length, patterns
        self.shift: dict[tuple[bytes, bytes], int] = {}
        self.bucket: dict[tuple[bytes, bytes], list[tuple[bytes, ...]]] = {}
        for p in patterns:
            for end in range(1, length):
                block, move = (p[end - 1], p[end]), length - 1 - end
                if move < self.shift.get(block, length):
                    self.shift[block] = move
            if length > 1:
                self.bucket.setdefault((p[-2], p[-1]), []).append(p)

    def find(self, words: list[bytes]) -> Iterator[tuple[int, list]]:
        """(start, items) of every occurrence."""
        length, n = self.length, len(words)
        if length == 1:
            known = self.patterns
            for i, w in enumerate(words):
                if (w,) in known:
                    yield i, known[(w,)]
            return
        shift, most, at = self.shift, length - 1, length - 1
        while at < n:
            move = shift.get((words[at - 1], words[at]), most)
            if move:
                at += move
                continue
            start = at - most
            for p in self.bucket[(words[at - 1], words[at])]:
                if words[start] == p[0] and tuple(words[start : at + 1]) == p:
                    yield start, self.patterns[p]
            at += 1


def build(items: list[tuple[object, bytes | None]], window: int = WINDOW) -> list[Patterns]:
    by_length: dict[int, dict[tuple[bytes, ...], list]] = {}
    for item, text in items:
        words = words_of(text)
        size = min(window, len(words))
        if item is None or not size:
            continue
        for i in range(len(words) - size + 1):
            owners = by_length.setdefault(size, {}).setdefault(tuple(words[i : i + size]), [])
            if item not in owners:
                owners.append(item)
    return [Patterns(k, p) for k, p in sorted(by_length.items())]


def search(tables: list[Patterns], text: bytes | None) -> tuple[int, np.ndarray, set]:
    """Words of a text, which of them are hit, and the items that occur."""
    words = words_of(text)
    hit, items = np.zeros(len(words), bool), set()
    for t in tables:
        for start, owners in t.find(words):
            hit[start : start + t.length] = True
            items.update(owners)
    return len(words), hit, items


def digest(items: set) -> str:
    return hashlib.sha256(",".join(sorted(map(str, items))).encode()).hexdigest()


RESULT = "n_words bigint, n_hit bigint, n_items bigint, items_sha256 string"


def _hits(n: list[int], hit: list[int], items: list[set]) -> pa.Array:
    return pa.StructArray.from_arrays(
        [pa.array(n, pa.int64()), pa.array(hit, pa.int64()), pa.array([len(x) for x in items], pa.int64()), pa.array([digest(x) for x in items])],
        names=["n_words", "n_hit", "n_items", "items_sha256"],
    )


def _parts(benchmark: DataFrame, part_bytes: int) -> int:
    total = benchmark.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    return max(1, -(-total // part_bytes))


def _tables(benchmark: DataFrame, part: int, parts: int, window: int):
    held = benchmark.where(F.col("text").isNotNull() & F.col("item_id").isNotNull())
    if parts > 1:
        held = held.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(parts)) == part)
    found = [(r.item_id, bytes(r.t)) for r in held.select("item_id", utf8().alias("t")).collect()]  # about part_bytes at most
    return benchmark.sparkSession.sparkContext.broadcast(build(found, window))


def hit_column(benchmark: DataFrame, window: int = WINDOW):
    """A function of a text column (as bytes): RESULT. For benchmarks of one part."""
    tables = _tables(benchmark, 0, 1, window)

    @F.arrow_udf(f"struct<{RESULT}>")
    def find(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        own = tables.value
        for texts in batches:
            rows = [search(own, x.as_py()) for x in texts]
            yield _hits([r[0] for r in rows], [int(r[1].sum()) for r in rows], [r[2] for r in rows])
        rows = texts = None
        give_back()

    return find


def _in_parts(docs: DataFrame, benchmark: DataFrame, parts: int, window: int, text: str = "text") -> DataFrame:
    """docs with __op10: RESULT, found part by part: each pass ors its hits into a bitmap and adds its items."""
    held = docs.withColumn("__op10_state", F.struct(F.lit(None).cast("binary").alias("hit"), F.lit(None).cast("array<string>").alias("items")))
    for part in range(parts):
        tables = _tables(benchmark, part, parts, window)

        @F.arrow_udf("struct<hit: binary, items: array<string>>")
        def more(batches: Iterator[tuple[pa.Array, pa.Array, pa.Array]], tables=tables) -> Iterator[pa.Array]:
            own = tables.value
            for texts, before, names in batches:
                hits, items = [], []
                for x, b, have in zip(texts, before, names, strict=True):
                    _, hit, found = search(own, x.as_py())
                    bits = np.packbits(hit)
                    if b.is_valid:
                        bits = bits | np.frombuffer(b.as_py(), np.uint8)
                    hits.append(bits.tobytes())
                    items.append(sorted(set(have.as_py() or []) | set(map(str, found))))
                yield pa.StructArray.from_arrays([pa.array(hits, pa.binary()), pa.array(items, pa.list_(pa.string()))], names=["hit", "items"])

        held = durable(held.withColumn("__op10_state", more(utf8(text), F.col("__op10_state.hit"), F.col("__op10_state.items"))), "hits")

    @F.arrow_udf(f"struct<{RESULT}>")
    def close(batches: Iterator[tuple[pa.Array, pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for texts, hits, items in batches:
            counts = [int(np.bitwise_count(np.frombuffer(h.as_py(), np.uint8)).sum()) for h in hits]
            yield _hits([len(words_of(x.as_py())) for x in texts], counts, [set(i.as_py()) for i in items])

    return held.withColumn("__op10", close(utf8(text), F.col("__op10_state.hit"), F.col("__op10_state.items"))).drop("__op10_state")


def contamination(docs: DataFrame, benchmark: DataFrame, least_items: int = 2, window: int = WINDOW, part_bytes: int = PART_BYTES) -> DataFrame:
    """(doc_id, n_words, n_hit, n_items, items_sha256, contaminated) for each row of docs."""
    parts = _parts(benchmark, part_bytes)
    slim = docs.select("doc_id", "text")
    found = slim.select("doc_id", hit_column(benchmark, window)(utf8()).alias("__op10")) if parts == 1 else _in_parts(slim, benchmark, parts, window)
    return found.select("doc_id", "__op10.*").withColumn("contaminated", F.col("n_items") >= least_items)


def keep_clean(docs: DataFrame, benchmark: DataFrame, least_items: int = 1, window: int = WINDOW, part_bytes: int = PART_BYTES) -> DataFrame:
    """The rows of docs in which fewer than least_items items occur."""
    parts = _parts(benchmark, part_bytes)
    if parts == 1:
        return docs.where(hit_column(benchmark, window)(utf8())["n_items"] < least_items)
    return _in_parts(docs, benchmark, parts, window).where(F.col("__op10.n_items") < least_items).select(*docs.columns)
