"""Sharding in Hilbert-curve order: rows near in several metadata dimensions land near each other, so a file's
min/max statistics prune in all of them.

Dimensions: language, source and size, each cut at its quantiles into at most 2^bits cells, so that cells hold about equal
numbers of rows and follow the order of the values: min and max of a file then bound what it holds. Names count by the
six bytes that follow what all names of the column share, so no dictionary of them is gathered; names equal in those
bytes share a cell. The quantiles come from sketches of bounded size. The curve index interleaves the cells after Skilling's
transform, as SQL arithmetic. Rows are range-partitioned and sorted by curve index, then by text digest and doc_id, so equal
texts lie side by side: a group of copies takes the dimensions of its smallest (source, lang), one aggregate row a group. Runs
are cut by position: a row's position is its task's offset plus its index in the task, so nothing is sorted in one place.

Law `rows`: shard counts differ by one at most. A shard is the run [ceil(k N / n), ceil((k+1) N / n)).

Edge cases: null texts have no bytes; null lang and source are values of their own, before all others; repeated rows each get
a slot; very long texts are rows like any other; fewer rows than shards leave shards empty; an empty table gives an empty
table; columns of docs may have any names, and where shard or slot is taken ours is called __shard or __slot.
"""

from __future__ import annotations

import os

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import durable, unused, utf8

SHARDS = 40
ROW_BYTES = 16


def hilbert_index(axes: list[Column], bits: int) -> Column:
    """The Hilbert index of a point whose axes are integers below 2^bits (Skilling, 2004), as one long."""
    n = len(axes)

    def step(x: list[Column], i: int, q: int) -> list[Column]:
        """Invert the low bits of the first axis, or exchange them with axis i, as bit q of axis i says."""
        low, on = q - 1, x[i].bitwiseAND(F.lit(q)) != 0
        swap = x[0].bitwiseXOR(x[i]).bitwiseAND(F.lit(low))
        out = list(x)
        out[0] = F.when(on, x[0].bitwiseXOR(F.lit(low))).otherwise(x[0].bitwiseXOR(swap))
        if i:
            out[i] = F.when(on, x[i]).otherwise(x[i].bitwiseXOR(swap))
        return out

    # Each step's columns go through a lambda's variable, so that expressions do not double with every step.
    def stepped(i: int, q: int):
        def apply(s: Column) -> Column:
            return F.struct(*[c.alias(f"x{k}") for k, c in enumerate(step([s[f"x{k}"] for k in range(n)], i, q))])

        return apply

    start = F.struct(*[c.cast("long").alias(f"x{k}") for k, c in enumerate(axes)])
    state = F.array(start)
    for b in range(bits - 1, 0, -1):
        for i in range(n):
            state = F.transform(state, stepped(i, 1 << b))

    def finish(s: Column) -> Column:
        x = [s[f"x{k}"] for k in range(n)]
        for k in range(1, n):
            x[k] = x[k].bitwiseXOR(x[k - 1])
        turn = F.lit(0).cast("long")
        for b in range(bits - 1, 0, -1):
            turn = turn.bitwiseXOR(F.when(x[n - 1].bitwiseAND(F.lit(1 << b)) != 0, F.lit((1 << b) - 1)).otherwise(F.lit(0)))
        return F.struct(*[c.bitwiseXOR(turn).alias(f"x{k}") for k, c in enumerate(x)])

    def interleave(s: Column) -> Column:
        out = F.lit(0).cast("long")
        for b in range(bits - 1, -1, -1):
            for k in range(n):
                out = F.shiftleft(out, 1).bitwiseOR(F.shiftright(s[f"x{k}"], b).bitwiseAND(F.lit(1)))
        return out

    return F.transform(F.transform(state, finish), interleave)[0]


def sizes(text: str = "text") -> Column:
    return (F.coalesce(F.octet_length(text), F.lit(0)) + ROW_BYTES).cast("long")


class Cuts:
    """Where the cells of each dimension begin, from a table (lang, source, size)."""

    def __init__(self, rows: DataFrame, bits: int = 5):
        self.bits = bits
        names = ("lang", "source")
        ends = rows.agg(*[f(F.col(c).cast("string")).alias(f"{c}_{n}") for c in names for n, f in (("least", F.min), ("most", F.max))]).first()
        self.skip = {c: len(os.path.commonprefix([(ends[f"{c}_{n}"] or "").encode() for n in ("least", "most")])) for c in names}
        at = [k / (1 << bits) for k in range(1, 1 << bits)]
        numbers = {"size": F.col("size"), **{c: self.code(c, F.col(c)) for c in names}}
        found = rows.agg(*[F.percentile_approx(v, at, 10_000).alias(c) for c, v in numbers.items()]).first()
        # Not made distinct: a value that many rows share takes as many cells, so few values still spread over the whole range.
        self.edges = {c: sorted(found[c] or []) for c in numbers}

    def code(self, column: str, name: Column) -> Column:
        """Six bytes of a name as a number in the order of names; null is the least."""
        own = F.substring(name.cast("string").cast("binary"), self.skip[column] + 1, 6)
        return F.coalesce(F.conv(F.rpad(F.hex(own), 12, "0"), 16, 10).cast("long"), F.lit(-1).cast("long"))

    def cell(self, column: str, value: Column) -> Column:
        number = value if column == "size" else self.code(column, value)
        edges = F.array(*[F.lit(e).cast("long") for e in self.edges[column]]) if self.edges[column] else F.array().cast("array<bigint>")
        return F.aggregate(edges, F.lit(0), lambda n, e: n + (e < number).cast("int"))

    def curve(self, lang: Column, source: Column, size: Column) -> Column:
        return hilbert_index([self.cell("lang", lang), self.cell("source", source), self.cell("size", size)], self.bits)


def assign(rows: DataFrame, order: list, shards: int = SHARDS, columns: list[str] | None = None) -> DataFrame:
    """rows with shard and slot: cut into equal runs in the order of `order`, whose last key must tell rows apart."""
    spark = rows.sparkSession
    keys = [unused(rows, f"k{i}") for i in range(len(order))]
    at, place = unused(rows, "at"), unused(rows, "place")
    keyed = rows.withColumns(dict(zip(keys, order, strict=True)))
    count = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)
    laid = durable(
        keyed.repartitionByRange(count, *keys).sortWithinPartitions(*keys).drop(*keys).withColumn(at, F.monotonically_increasing_id()),
        "laid",
    )
    task, index = F.shiftright(at, 33), F.col(at).bitwiseAND(F.lit((1 << 33) - 1))
    counts = laid.groupBy(task.alias("task")).agg(F.count(F.lit(1)).alias("n"))
    # One number a task, never more than the shuffle partitions.
    starts, total = {}, 0
    for t, n in sorted((r.task, r.n) for r in counts.collect()):
        starts[t] = total
        total += n
    offset = F.element_at(F.array(*[F.lit(starts.get(t, 0)).cast("long") for t in range(max(starts, default=0) + 1)]), task.cast("int") + 1)
    whole = lambda a, b: F.call_function("div", a, F.lit(b).cast("long"))
    shard = whole(F.col(place) * F.lit(shards), max(total, 1))
    first = whole(shard * F.lit(max(total, 1)) + F.lit(shards - 1), shards)
    own = columns or rows.columns
    taken = {c.lower() for c in own}
    names = [c if c not in taken else unused(rows, c) for c in ("shard", "slot")]
    return laid.withColumn(place, offset + index).select(*[F.col(f"`{c}`") for c in own], shard.cast("int").alias(names[0]), (F.col(place) - first).alias(names[1]))


def shard_assignments(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """(doc_id, size, text_crc32, law, shard, slot, grown_shard, curve) for each row of docs; groups of equal texts stay together."""
    slim = durable(
        docs.select(
            "doc_id",
            sizes().alias("size"),
            F.crc32(F.coalesce(utf8(), F.lit(b""))).alias("text_crc32"),
            F.xxhash64(F.coalesce("text", F.lit("")), F.lit(6)).alias("digest"),
            "lang",
            "source",
            F.monotonically_increasing_id().alias("row"),
        ),
        "slim",
    )
    cuts = Cuts(slim)
    group = ["digest", "text_crc32", "size"]
    # Only groups of several rows need shared dimensions; the others keep their own. Written, so that the join stands on
    # shuffles of its own, which Spark can split at a hot text.
    shared = durable(
        slim.groupBy(*group).agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("source", "lang")).alias("m")).where("n > 1").drop("n"),
        "shared",
    )
    placed = slim.join(shared, group, "left").select(
        "doc_id",
        "size",
        "text_crc32",
        "digest",
        "row",
        cuts.curve(
            F.when(F.col("m").isNotNull(), F.col("m.lang")).otherwise(F.col("lang")),
            F.when(F.col("m").isNotNull(), F.col("m.source")).otherwise(F.col("source")),
            F.col("size"),
        ).alias("curve"),
    )
    order = [F.col("curve"), F.col("digest"), F.col("doc_id"), F.col("row")]
    out = assign(placed, order, shards, ["doc_id", "size", "text_crc32", "curve"])
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "curve")


def shard_documents(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """docs with shard and slot, texts and all; repeated rows lie side by side as they share all dimensions."""
    cuts = Cuts(docs.select("lang", "source", sizes().alias("size")))
    curve = cuts.curve(F.col("lang"), F.col("source"), sizes())
    order = [curve, F.xxhash64(F.coalesce("text", F.lit("")), F.lit(6)), F.col("doc_id"), F.monotonically_increasing_id()]
    return assign(docs, order, shards)


def write_shards(docs: DataFrame, path: str, shards: int = SHARDS) -> None:
    """One folder a shard, rows in slot order."""
    out = shard_documents(docs, shards)
    shard, slot = out.columns[-2:]
    out.repartition(shards, shard).sortWithinPartitions(shard, slot).write.partitionBy(shard).parquet(path)
