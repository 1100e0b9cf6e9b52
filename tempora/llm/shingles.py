"""Near-dedup by SimHash: documents whose sets of word shingles have a Jaccard similarity of at least `similarity`.

SimHash proposes, the sets decide. A set's fingerprint is WORDS times 64 bits, each the majority of the set's mixed shingle
hashes; a tie goes to the bit of the least hash, so that few shingles make no bit likelier. A similarity s makes a cosine of
2s/(1+s) at the least, and a bit differs with a probability of acos(cosine)/pi (0.151 at 0.8; up to 0.161 for some sizes of less
than 40, simulated), whence `bands`: sets that agree in a band of bits (64 bands of 10 at 0.8) meet, and those that differ in
at most `far` of FAR other bits (of 192) are candidates. A pair at 0.8 shares no band, or lies farther, with a probability of 2
in 100,000 at most, and the nearer the less. Four shingles out of five differ in more bits (0.19): a set of at most SMALL is
also looked for under its fingerprints without one of them, which is the smaller set's own.

Equal sets are merged before any band is made, so exact copies cost one row. A bucket gives a spanning forest of its candidates,
never pairs, and a bucket of more than BUCKET rows is dealt as pairs of blocks. The components of all candidates hold every
link; each different set is sent to the one task of its component, which compares whole sets there and returns a
spanning forest of the links of `similarity` or more: at most one link a member, never pairs. A component of more than BLOCK
members or BLOCK_BYTES of sets is dealt as pairs of blocks, so no task holds more than two blocks; members that stay
unlinked to each other then cost time, and sets sent, with the square of the number of blocks. Texts are not shuffled
unless the rows to look up, a written table, are more than Spark broadcasts.

Sets are compared by 32 bits of each shingle's hash. For two texts of 20,000 words, one in ten pairs of texts then counts one
shingle too many as common, of 20,000; for ordinary texts none does.

Edge cases: texts without words have the empty set and are copies of each other, null or empty; texts of fewer words
than a shingle are one shingle; very long texts are hashed whole, CHUNK shingles at a time; repeated rows and
rows that share a doc_id are told apart by a written row number, and rows with a null doc_id take part, after all others;
an empty table gives an empty table; columns of docs may have any names beside doc_id and text.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, durable, give_back, unused, utf8
from .simhash import components, shingle_hashes

#: Words of 64 bits in a fingerprint: those compared whole, then those cut into bands.
FAR_WORDS, BAND_WORDS = 3, 10
WORDS, FAR, BAND_BITS = FAR_WORDS + BAND_WORDS, 64 * FAR_WORDS, 64 * BAND_WORDS
#: A pair at the bound is missed by all bands, and by the distance, with at most this probability each.
MISS = 1e-5
#: Sets of at most so many shingles are also looked for without one of them.
SMALL = 5
#: Shingles whose bits are summed at once, in one byte each.
CHUNK = 255
#: Rows of a bucket that make up one block, and pairs of them compared at once.
BUCKET, PAIRS = 1 << 13, 1 << 18
#: Members of a component, and bytes of their sets, that make up one block.
BLOCK, BLOCK_BYTES = 256, 4 << 20
STEPS = np.arange(1, WORDS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)


def shingle_set(text: bytes | None, width: int) -> np.ndarray:
    """The sorted hashes of a text's different shingles."""
    return np.unique(shingle_hashes(text, width))


def wide_fingerprint(shingles: np.ndarray) -> bytes:
    """The SimHash of a sorted set that is not empty: bitwise majorities of WORDS mixes (splitmix64) of each hash."""
    ones = np.zeros(64 * WORDS, np.int64)
    for at in range(0, len(shingles), CHUNK):
        z = shingles[at : at + CHUNK, None] + STEPS
        z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        bits = np.unpackbits((z ^ (z >> np.uint64(31))).view(np.uint8), axis=1, bitorder="little")
        if not at:
            tie = bits[0]
        ones += np.add.reduce(bits, axis=0, dtype=np.uint8)
    return np.packbits(2 * ones + tie > len(shingles), bitorder="little").tobytes()


def fingerprints(shingles: np.ndarray, similarity: float) -> bytes:
    """A set's fingerprint and, of a small set, those without one shingle, where that is similar enough."""
    out, n = wide_fingerprint(shingles), len(shingles)
    if 1 < n <= SMALL and n - 1 >= similarity * n - 1e-9:
        out += b"".join(wide_fingerprint(np.delete(shingles, i)) for i in range(n))
    return out


def bands(similarity: float) -> tuple[int, int]:
    """Bits of a band and the bits of FAR in which a candidate may differ, by MISS."""
    p = math.acos(2 * similarity / (1 + similarity)) / math.pi + 0.01  # sets of few shingles differ in somewhat more bits
    width = max(w for w in range(1, 17) if (1 - (1 - p) ** w) ** (BAND_BITS // w) <= MISS)
    beyond, far = 1.0, -1
    while beyond > MISS:
        far += 1
        beyond -= math.comb(FAR, far) * p**far * (1 - p) ** (FAR - far)
    return width, far


def sketch_column(width: int, similarity: float):
    """Of a text the digest of its set, the set's size, and its fingerprints."""

    @F.arrow_udf("struct<h1: bigint, h2: bigint, n: bigint, prints: binary>")
    def sketch(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            digests, sizes, prints = [], [], []
            for x in texts:
                own = shingle_set(x.as_py(), width)
                digests.append(xxhash.xxh3_128_digest(own.tobytes()))
                sizes.append(len(own))
                prints.append(fingerprints(own, similarity) if len(own) else b"")
            h = np.frombuffer(b"".join(digests), "<i8").reshape(-1, 2)
            fields = [pa.array(h[:, 0].copy()), pa.array(h[:, 1].copy()), pa.array(sizes, pa.int64()), pa.array(prints, pa.binary())]
            yield pa.StructArray.from_arrays(fields, names=["h1", "h2", "n", "prints"])
        texts = None
        give_back()

    return sketch


def _band_rows(width: int):
    """mapInArrow over rows (node, prints): a row (key, node, f0, f1, f2) for each band; fingerprints after the first have one band."""
    weights = 1 << np.arange(width)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints = batch.column(1).to_pylist()
            many = np.array([len(p) // (8 * WORDS) for p in prints], np.int64)
            words = np.frombuffer(b"".join(prints), "<u8").reshape(-1, WORDS)
            nodes = np.repeat(np.asarray(batch.column(0)), many)
            first = (np.cumsum(many) - many)[many > 0]
            bits = np.unpackbits(np.ascontiguousarray(words[:, FAR_WORDS:]).view(np.uint8), axis=1, bitorder="little")
            for t in range(BAND_BITS // width):
                at = first if t else np.arange(len(words))
                key = bits[at, t * width : (t + 1) * width] @ weights + (t << width)
                columns = [key, nodes[at], *[words[at, i].view(np.int64) for i in range(FAR_WORDS)]]
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["key", "node", "f0", "f1", "f2"])
        batch = None
        give_back()

    return rows


def near_forest(prints: np.ndarray, far: int) -> list[tuple[int, int]]:
    """A forest over fingerprints (rows of FAR_WORDS words) with the components that distances of at most `far` give, as places."""

    def apart(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return sum(np.bitwise_count(a[..., i] ^ b[..., i]) for i in range(FAR_WORDS))

    met, step = np.zeros(len(prints), bool), max(1, PAIRS // len(prints))
    for at in range(0, len(prints), step):  # most fingerprints are near to none
        near = apart(prints[at : at + step, None], prints[None, at:]) <= far
        np.fill_diagonal(near, False)
        met[at : at + step] |= near.any(axis=1)
        met[at:] |= near.any(axis=0)
    out, rest = [], np.flatnonzero(met)
    while len(rest) > 1:
        frontier, rest = [rest[0]], rest[1:]
        while frontier and len(rest):
            place = frontier.pop()
            near = apart(prints[rest], prints[place]) <= far
            out += [(int(place), int(k)) for k in rest[near]]
            frontier += rest[near].tolist()
            rest = rest[~near]
    return out


def _bucket_candidates(far: int):
    """mapInArrow over rows (key, i, j, node, f0, f1, f2) sorted by the first three: a forest (a, b) of each bucket's candidates."""

    def candidates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []

        def close() -> tuple[np.ndarray, np.ndarray]:
            rows = np.concatenate(held)
            found = np.array(near_forest(rows[:, 4:].view(np.uint64), far), np.int64).reshape(-1, 2)
            return rows[found[:, 0], 3], rows[found[:, 1], 3]

        def links(pairs: list[tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(np.concatenate([p[k] for p in pairs])) for k in range(2)], names=["a", "b"])

        for batch in batches:
            if not batch.num_rows:
                continue
            rows, out = np.stack([np.asarray(c) for c in batch.columns], axis=1), []
            cuts = np.flatnonzero((rows[1:, :3] != rows[:-1, :3]).any(axis=1)) + 1
            for lo, hi in zip([0, *cuts], [*cuts, len(rows)], strict=True):
                if held and (held[0][0, :3] != rows[lo, :3]).any():
                    out.append(close())
                    held = []
                held.append(rows[lo:hi])
            if out:
                yield links(out)
        if held:
            yield links([close()])
        held = batch = rows = None
        give_back()

    return candidates


def set_column(width: int):
    """Of a text its set as sorted 32-bit numbers."""

    @F.arrow_udf("binary")
    def whole(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            yield pa.array([np.unique(_short(shingle_hashes(x.as_py(), width))).tobytes() for x in texts], pa.binary())
        texts = None
        give_back()

    return whole


def _short(hashes: np.ndarray) -> np.ndarray:
    return (hashes >> np.uint64(32)).astype("<u4")


def similar_links(sets: list[np.ndarray], similarity: float) -> list[tuple[int, int]]:
    """A forest over the sets (not empty) with the components that links of at least `similarity` give, as places in the list."""
    out: list[tuple[int, int]] = []
    left = np.arange(len(sets))  # places not yet linked to anything, and those among them already taken
    while len(left) > 1:
        sizes = np.array([len(sets[i]) for i in left])
        starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
        _, ids = np.unique(np.concatenate([sets[i] for i in left]), return_inverse=True)
        marked, free = np.zeros(ids.max() + 1, bool), np.ones(len(left), bool)
        frontier: list[int] = []
        enough = len(left) // 2  # where no more than half are left, the arrays are built anew
        while free.any() and (frontier or free.sum() > enough):
            if not frontier:
                frontier.append(int(np.argmax(free)))
                free[frontier[0]] = False
            at = frontier.pop()
            own = ids[starts[at] : starts[at] + sizes[at]]
            marked[own] = True
            common = np.add.reduceat(marked[ids].astype(np.int64), starts)
            marked[own] = False
            near = np.flatnonzero(free & (common >= similarity * (sizes + sizes[at] - common) - 1e-9))
            free[near] = False
            out += [(int(left[at]), int(left[k])) for k in near]
            frontier += near.tolist()
        left = left[free]
    return out


def _group_links(similarity: float):
    """mapInArrow over rows (key, i, j, node, s) sorted by the first three: links (a, b) between nodes of each group."""

    def links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held = None, {}

        def close() -> pa.RecordBatch:
            nodes = list(held)
            found = similar_links([held[n] for n in nodes], similarity)
            a, b = [nodes[x] for x, _ in found], [nodes[y] for _, y in found]
            return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

        for batch in batches:
            keys = list(zip(*[batch.column(c).to_pylist() for c in range(3)], strict=True))
            for key, node, s in zip(keys, batch.column(3).to_pylist(), batch.column(4), strict=True):
                if key != at:
                    if len(held) > 1:
                        yield close()
                    at, held = key, {}
                held[node] = np.frombuffer(s.as_py(), "<u4")
        if len(held) > 1:
            yield close()
        held = batch = None
        give_back()

    return links


def candidates(sets: DataFrame, similarity: float, bucket: int = BUCKET) -> DataFrame | None:
    """(node, root): the components of all sets (node, prints) whose fingerprints are near; None if none are."""
    width, far = bands(similarity)
    rows = sets.select("node", "prints").mapInArrow(_band_rows(width), "key bigint, node bigint, f0 bigint, f1 bigint, f2 bigint")
    large = durable(
        rows.groupBy("key").count().where(F.col("count") > bucket).select("key", F.ceil(F.col("count") / bucket).cast("int").alias("blocks")), "large"
    )
    blocks = F.coalesce("blocks", F.lit(1))
    own = F.pmod(F.xxhash64("node", F.lit(7)), F.col("blocks")).cast("int")
    dealt = (
        rows.join(F.broadcast(large), "key", "left")  # at most one row a key: bands times 2^width
        .withColumn("blocks", blocks)
        .select("*", own.alias("own"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
        .select("key", F.least("own", "other").cast("long").alias("i"), F.greatest("own", "other").cast("long").alias("j"), "node", "f0", "f1", "f2")
        .repartition("key", "i", "j")
        .sortWithinPartitions("key", "i", "j")
    )
    found = components(dealt.mapInArrow(_bucket_candidates(far), "a bigint, b bigint"))
    discard(large)
    return found


def links(rows: DataFrame, sets: DataFrame, similarity: float, width: int, block: int = BLOCK, block_bytes: int = BLOCK_BYTES) -> DataFrame | None:
    """(node, root): the components of all links found; None if there are none.

    rows: (row, text); sets: (node, n, prints), one row for each different set, under the row number of one of its texts.
    """
    near = candidates(sets, similarity)
    if near is None:
        return None
    # Written, here and below, so that a join stands on shuffles of its own, which Spark can split at a hot key.
    members = durable(near.join(sets.select("node", "n"), "node").select(F.col("root").alias("key"), "node", "n"), "members")
    discard(near)
    blocks = F.ceil(F.greatest(F.count(F.lit(1)) / block, F.sum("n") * 4 / block_bytes)).cast("int")
    groups = durable(members.groupBy("key").agg(blocks.alias("blocks")), "groups")
    placed = durable(members.join(groups, "key").select("key", "blocks", "node"), "placed")
    whole = durable(rows.join(placed, rows["row"] == placed["node"], "left_semi").select(F.col("row").alias("node"), set_column(width)(utf8()).alias("s")), "sets")
    own = F.pmod(F.xxhash64("node", F.lit(7)), F.col("blocks")).cast("int")
    dealt = (
        placed.join(whole, "node")
        .select("key", "node", "s", own.alias("own"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
        .select("key", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "node", "s")
        .repartition("key", "i", "j")
        .sortWithinPartitions("key", "i", "j")
    )
    found = components(dealt.mapInArrow(_group_links(similarity), "a bigint, b bigint"))
    for table in (members, groups, placed, whole):
        discard(table)
    return found


def keep_one(docs: DataFrame, similarity: float = 0.8, width: int = 5) -> DataFrame:
    """docs without near-duplicates: of each component the row of the smallest (doc_id, row) stays, null ids last."""
    row, sketch = unused(docs, "row"), unused(docs, "sketch")
    rows = durable(docs.withColumn(sketch, sketch_column(width, similarity)(utf8())).withColumn(row, F.monotonically_increasing_id()), "rows")
    rank = F.struct(F.col("doc_id").isNull().alias("unnamed"), F.col("doc_id").alias("doc_id"), F.col(row).alias("row"))
    sets = durable(
        rows.groupBy(f"{sketch}.h1", f"{sketch}.h2").agg(
            F.min(row).alias("node"), F.min(rank).alias("least"), F.first(f"{sketch}.n").alias("n"), F.first(f"{sketch}.prints").alias("prints")
        ),
        "distinct",
    )
    roots = links(rows.select(F.col(row).alias("row"), "text"), sets.select("node", "n", "prints"), similarity, width)
    if roots is None:
        least = sets
    else:
        least = sets.join(roots, "node", "left").groupBy(F.coalesce("root", "node").alias("root")).agg(F.min("least").alias("least"))
    gone = durable(rows.select(row).join(least.select(F.col("least.row").alias(row)), row, "left_anti"), "gone")
    discard(sets)
    return rows.join(gone, row, "left_anti").select(*[F.col(f"`{c}`") for c in docs.columns])
