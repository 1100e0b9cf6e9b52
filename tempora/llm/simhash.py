"""SimHash near-dedup with covering locality-sensitive hashing (masks after Pagh, "CoveringLSH", 2016).

A fingerprint is the bitwise majority of the XXH64 values of a text's word shingles. To find every pair within
`radius` differing bits, each bit position gets a non-zero label of radius+1 bits, and each of the 2^(radius+1)-1
non-zero vectors v gives a mask that keeps the positions whose label has an odd product with v. At most `radius`
differing positions give at most `radius` linear equations in radius+1 unknowns, so some v solves them all: its mask
drops every differing position and the pair collides there. No pair within the radius is missed.

Equal fingerprints are merged before any table is made, so exact copies cost one row. A bucket of two is a pair, made
from min and max in the aggregate itself. A larger bucket is dealt as pairs of bounded blocks, and each block pair
yields a spanning forest of its links, never all pairs. Components come from contraction rounds over the links, each
round a written table.

Edge cases: null or word-less texts have fingerprint zero and link like any other; repeated rows each return a row;
rows with a null doc_id take part, but a null never is a component's smallest id while another exists; very long texts are
hashed whole, CHUNK shingles at a time; ties cannot be, as ids and rows order; an empty table gives an empty table; columns of
docs may have any names beside doc_id and text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LOWER, discard, durable, give_back, unused, utf8

SEED = 42
#: Shingles whose bits are summed at once: 64 bytes each.
CHUNK = 1 << 15
#: Fingerprints of one bucket that one task compares at once are at most twice this.
BLOCK = 8192


def shingle_hashes(text: bytes | None, width: int) -> np.ndarray:
    """The XXH64 values of a UTF-8 text's `width`-word shingles, in order; of a shorter text's words as one."""
    words = (text or b"").translate(LOWER).split()
    if not words:
        return np.zeros(0, "<u8")
    joined = b" ".join(words)
    if len(words) <= width:
        return np.array([xxhash.xxh64_intdigest(joined, SEED)], "<u8")
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(lengths + 1) - 1
    starts = (ends - lengths)[: len(words) - width + 1].tolist()
    stops = ends[width - 1 :].tolist()
    digest = xxhash.xxh64_intdigest
    return np.array([digest(joined[a:b], SEED) for a, b in zip(starts, stops, strict=True)], "<u8")


def fingerprint(text: bytes | None, width: int) -> int:
    """The unsigned SimHash of a UTF-8 text over `width`-word shingles."""
    hashes = shingle_hashes(text, width)
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), CHUNK):
        bits = np.unpackbits(hashes[at : at + CHUNK].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, width: int = 5, beside: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, fp) and the columns `beside`: one row for each row of docs; fp is the fingerprint as a signed long."""

    @F.arrow_udf("bigint")
    def simhash(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            values = np.fromiter((fingerprint(x.as_py(), width) for x in texts), np.uint64, len(texts))
            yield pa.array(values.view(np.int64))
        texts = None
        give_back()

    return docs.select("doc_id", *beside, simhash(utf8()).alias("fp"))


def covering_masks(radius: int, bits: int = 64) -> list[int]:
    """2^(radius+1)-1 masks such that any two words differing in at most `radius` bits agree under one of them."""
    full = (1 << (radius + 1)) - 1
    labels = [i % full + 1 for i in range(bits)]
    return [sum(1 << i for i, label in enumerate(labels) if (label & v).bit_count() & 1) for v in range(1, full + 1)]


def spanning_links(fps: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """A forest over distinct fps with the components that links within `radius` give."""
    rest, left, right = fps, [], []
    while len(rest) > 1:
        frontier, rest = [rest[0]], rest[1:]
        while frontier and len(rest):
            node = frontier.pop()
            near = np.bitwise_count(rest ^ node) <= radius
            if near.any():
                found = rest[near]
                left.append(np.full(len(found), node))
                right.append(found)
                frontier.extend(found)
                rest = rest[~near]
    none = np.zeros(0, fps.dtype)
    return (np.concatenate(left), np.concatenate(right)) if left else (none, none)


def _bucket_links(radius: int):
    """mapInArrow over rows (bucket..., fp) that are sorted by bucket: the links of each bucket, one bucket at a time."""

    def links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        at = None

        def close():
            a, b = spanning_links(np.unique(np.concatenate(held)).view(np.uint64), radius)
            return pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], names=["a", "b"])

        for batch in batches:
            if not batch.num_rows:
                continue
            keys = np.stack([np.asarray(batch.column(i)) for i in range(batch.num_columns - 1)], axis=1)
            fps = np.asarray(batch.column(batch.num_columns - 1))
            cuts = np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1
            for lo, hi in zip([0, *cuts], [*cuts, len(fps)], strict=True):
                key = tuple(keys[lo])
                if held and key != at:
                    yield close()
                    held = []
                at = key
                held.append(fps[lo:hi])
        if held:
            yield close()
        held = batch = None
        give_back()

    return links


def links(fps: DataFrame, radius: int = 4, block: int = BLOCK) -> DataFrame:
    """(a, b): links between distinct fingerprints, enough for the components of all links within `radius`.

    fps: one column fp of distinct values.
    """
    signed = [m - (1 << 64) if m >> 63 else m for m in covering_masks(radius)]
    # A fingerprint is 8 bytes and becomes many rows: dealt to all tasks first, as its table is a few small files.
    rows = fps.repartition(int(fps.sparkSession.conf.get("spark.sql.shuffle.partitions")), "fp").select(
        "fp",
        F.explode(
            F.array(*[F.struct(F.lit(i).alias("t"), F.col("fp").bitwiseAND(F.lit(m)).alias("key")) for i, m in enumerate(signed)])
        ).alias("s"),
    ).select("s.t", "s.key", "fp")
    buckets = durable(
        rows.groupBy("t", "key")
        .agg(F.count(F.lit(1)).alias("n"), F.min("fp").alias("a"), F.max("fp").alias("b"))
        .where("n > 1"),
        "buckets",
    )
    pairs = buckets.where("n = 2").select("a", "b").where(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= radius)
    large = buckets.where("n > 2").select("t", "key", F.ceil(F.col("n") / block).cast("int").alias("blocks"))
    placed = rows.join(large, ["t", "key"]).withColumn("own", F.pmod(F.xxhash64("fp"), F.col("blocks")).cast("int"))
    dealt = placed.select(
        "t", "key", "own", "fp", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other")
    ).select(
        F.col("t").cast("long").alias("t"),
        "key",
        F.least("own", "other").cast("long").alias("i"),
        F.greatest("own", "other").cast("long").alias("j"),
        "fp",
    )
    within = (
        dealt.repartition("t", "key", "i", "j")
        .sortWithinPartitions("t", "key", "i", "j")
        .mapInArrow(_bucket_links(radius), "a bigint, b bigint")
    )
    return pairs.unionByName(within).distinct()


def components(edges: DataFrame) -> DataFrame | None:
    """(node, root): a common root for the nodes of each component of edges (a, b); None if there are no edges.

    Each round maps every node to the least of its neighbours and itself, moves the edges to the mapped nodes and
    drops loops. Rounds by value, which end a star at once, take turns with rounds by a hash that differs each time, which
    about halve even a chain of ascending values. Every round's tables are written.
    """

    def rank(node: str, turn: int):
        return F.struct(F.xxhash64(node, F.lit(turn)).alias("h"), F.col(node).alias("node"))

    def least_near(both: DataFrame, turn: int) -> DataFrame:
        if turn % 2 == 0:
            return both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), F.least("a", "m").alias("m"))
        near = both.groupBy("a").agg(F.min(rank("b", turn)).alias("m"))
        return near.select(F.col("a").alias("node"), F.least(rank("a", turn), F.col("m"))["node"].alias("m"))

    edges = durable(edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
    labels, turn = None, 0
    while edges.limit(1).count():
        both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        lower = durable(least_near(both, turn), "lower")
        turn += 1
        if labels is None:
            labels = durable(lower.select("node", F.col("m").alias("root")), "labels")
        else:
            step = lower.select(F.col("node").alias("root"), F.col("m"))
            moved = durable(labels.join(step, "root", "left").select("node", F.coalesce("m", "root").alias("root")), "labels")
            discard(labels)
            labels = moved
        end_a = lower.select(F.col("node").alias("a"), F.col("m").alias("ma"))
        end_b = lower.select(F.col("node").alias("b"), F.col("m").alias("mb"))
        after = durable(
            edges.join(end_a, "a")
            .join(end_b, "b")
            .where("ma <> mb")
            .select(F.least("ma", "mb").alias("a"), F.greatest("ma", "mb").alias("b"))
            .distinct(),
            "edges",
        )
        discard(edges)
        discard(lower)
        edges = after
    discard(edges)
    return labels


def _rooted(prints: DataFrame, radius: int, least) -> DataFrame:
    """(fp, root, least): a common root for the fingerprints of each component, with the aggregate `least` of each one's rows."""
    distinct = durable(prints.groupBy("fp").agg(least.alias("least")), "distinct")
    roots = components(links(distinct.select("fp"), radius))
    if roots is None:
        return distinct.select("fp", F.col("fp").alias("root"), "least")
    return durable(
        distinct.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select("fp", F.coalesce("root", "fp").alias("root"), "least"),
        "placed",
    )


def near_duplicates(docs: DataFrame, radius: int = 4, width: int = 5) -> DataFrame:
    """(doc_id, fp, component_id), one row for each row of docs."""
    prints = durable(fingerprints(docs, width), "fingerprints")
    placed = _rooted(prints, radius, F.min("doc_id"))
    # Written, so that the join stands on shuffles of its own, which Spark can split at a large component.
    smallest = durable(placed.groupBy("root").agg(F.min("least").alias("component_id")), "smallest")
    final = durable(placed.join(smallest, "root").select("fp", "component_id"), "components")
    return prints.join(final, "fp").select("doc_id", "fp", "component_id")


def keep_one(docs: DataFrame, radius: int = 4, width: int = 5) -> DataFrame:
    """docs without near-duplicates: of each component the row of the smallest (doc_id, row) stays, null ids last."""
    row = unused(docs, "row")
    rows = durable(docs.withColumn(row, F.monotonically_increasing_id()), "rows")
    prints = durable(fingerprints(rows, width, (row,)), "fingerprints")
    rank = F.struct(F.col("doc_id").isNull().alias("unnamed"), F.col("doc_id").alias("doc_id"), F.col(row).alias("row"))
    least = _rooted(prints, radius, F.min(rank)).groupBy("root").agg(F.min("least").alias("least"))
    # Texts are read against the ids that go, which Spark broadcasts where they are few.
    gone = durable(prints.select(row).join(least.select(F.col("least.row").alias(row)), row, "left_anti"), "gone")
    return rows.join(gone, row, "left_anti").select(*[F.col(f"`{c}`") for c in docs.columns])


def hex16(column: str):
    return F.lower(F.lpad(F.hex(column), 16, "0"))
