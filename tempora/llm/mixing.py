"""Mixing sources to target weights with hash-threshold histograms.

A row's place is a 60-bit hash of its doc_id, uniform and the same in every run. Each source takes `base` whole copies
of all its rows (its target over its size, rounded down) and one copy more of the rows below a hash threshold. The
threshold comes from nested histograms: sizes are summed by source and leading hash bits with map-side sums, the bucket
in which the budget ends is found, only rows in that bucket are summed again by the next bits, and within the last
boundary bucket by the hash itself. Nothing is sorted but histograms, and the decision is a comparison.

Rows of equal hash (repeats of an id) are taken together. The rows at which the budget ends go in if that comes nearer
to the target. Sources are one aggregate row each; their targets are computed in SQL, not on the driver.

Edge cases: null texts have size 0; a null source is a source, last in order; null ids hash as the empty text; a
source of size 0 has target 0 and takes nothing, and a source that stops at its cap takes that many copies of each row and
none more, also of rows of size 0; repeated rows all count; very long texts count whole; an empty table gives an empty
table; columns of docs may have any names beside doc_id, text and source.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import SPACED_WORD, durable, unused

#: Bits a level, levels of histograms, and bits of the hash.
STEP, LEVELS, BITS = 12, 2, 60


def hash60(doc_id):
    """The first 60 bits of the md5 of an id written as text."""
    return F.conv(F.substring(F.md5(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), 1, BITS // 4), 16, 10).cast("long")


def words(text: str = "text"):
    return F.coalesce(F.regexp_count(text, F.lit(SPACED_WORD)), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights=(5, 2, 1), share: float = 1.5, most: float = 2.0) -> DataFrame:
    """sizes: (source, source_size), one row a source. Adds weight and target.

    Resharing what stops at a cap is water-filling: target = min(most x size, level x weight). In order of cap over
    weight the sources that stop come first, and the level follows from running sums over one row a source.
    """
    by_name = W.orderBy(F.col("source").isNull(), F.col("source"))
    named = sizes.withColumn("i", F.row_number().over(by_name)).withColumn(
        "weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("i") - 1) % len(weights) + 1)
    )
    order = W.orderBy(F.col("source_size") * most / F.col("weight"), "i")
    whole = W.partitionBy()
    filled = (
        named.withColumn("caps", F.sum(F.col("source_size") * most).over(order.rowsBetween(W.unboundedPreceding, 0)) - F.col("source_size") * most)
        .withColumn("open", F.sum("weight").over(order.rowsBetween(0, W.unboundedFollowing)))
        .withColumn("level", (F.sum("source_size").over(whole) * share - F.col("caps")) / F.col("open"))
        .withColumn("stops", F.col("level") * F.col("weight") >= F.col("source_size") * most)
    )
    # The sources that stop are a prefix of the order; the level is that of the first one that does not.
    first = filled.withColumn("rank", F.row_number().over(order)).withColumn(
        "level", F.min(F.when(~F.col("stops"), F.struct("rank", "level"))).over(whole)["level"]
    )
    target = F.when(F.col("level").isNull(), F.col("source_size") * most).otherwise(
        F.least(F.col("source_size") * most, F.col("level") * F.col("weight"))
    )
    return first.select("source", "source_size", "weight", target.cast("double").alias("target"))


def thresholds(slim: DataFrame, goals: DataFrame) -> DataFrame:
    """slim: (source, h, size); goals: targets(). Gives (source, source_size, target, base, below): rows with h < below get one more copy."""
    plan = durable(
        goals.withColumn("base", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("long"))
        .withColumn("budget", F.col("target") - F.col("base") * F.col("source_size"))
        .withColumn("prefix", F.lit(0).cast("long")),
        "plan",
    )
    edge = plan.select(F.col("source").alias("s"), "prefix", "budget")
    ends = None
    running = W.partitionBy("s").orderBy("bucket").rowsBetween(W.unboundedPreceding, 0)
    for level in range(1, LEVELS + 2):
        shift = BITS - STEP * level if level <= LEVELS else 0
        above = BITS - STEP * (level - 1)
        inside = slim.join(edge, slim["source"].eqNullSafe(edge["s"]) & (F.shiftright("h", above) == edge["prefix"]))
        sums = inside.groupBy("s", "budget", F.shiftright("h", shift).alias("bucket")).agg(F.sum("size").alias("size"))
        before = F.sum("size").over(running) - F.col("size")
        full = sums.withColumn("before", before)
        # The boundary bucket: the first whose sum reaches the budget. Finer levels look inside it only.
        reach = F.col("before") + F.col("size") >= F.col("budget")
        if level > LEVELS:
            reach = 2 * F.col("before") + F.col("size") > 2 * F.col("budget")
        edge = durable(
            full.where(reach)
            .groupBy("s")
            .agg(F.min(F.struct("bucket", "before", "budget")).alias("e"))
            .select("s", F.col("e.bucket").alias("prefix"), (F.col("e.budget") - F.col("e.before")).alias("budget")),
            "edge",
        )
        if level == LEVELS:
            end = F.shiftleft(F.col("prefix") + 1, BITS - STEP * LEVELS)
            ends = edge.select(F.col("s").alias("s2"), end.alias("end"))
    # Where all hashes of the last boundary bucket go in, the threshold is that bucket's end.
    cut = edge.select("s", F.col("prefix").alias("below"))
    joined = plan.join(ends, plan["source"].eqNullSafe(ends["s2"]), "left").join(cut, plan["source"].eqNullSafe(cut["s"]), "left")
    return joined.select(plan["source"], "source_size", "target", "base", F.when(plan["budget"] > 0, F.coalesce("below", "end", F.lit(1 << BITS))).otherwise(F.lit(0)).alias("below"))


def decide(slim: DataFrame) -> DataFrame:
    """thresholds() for slim (source, h, size), a written table."""
    sizes = durable(slim.groupBy("source").agg(F.sum("size").alias("source_size")), "sources")
    return durable(thresholds(slim.select("source", "h", "size"), targets(sizes)), "thresholds")


def mixture(docs: DataFrame) -> DataFrame:
    """(doc_id, source, size, source_size, target, copies, taken) for each row of docs. Texts are read once."""
    slim = durable(docs.select("doc_id", "source", hash60(F.col("doc_id")).alias("h"), words().alias("size")), "sizes")
    cuts = decide(slim).withColumnRenamed("source", "of")
    return (
        slim.join(cuts, slim["source"].eqNullSafe(cuts["of"]))  # Spark joins by the cuts' size: one row a source
        .withColumn("copies", F.col("base") + (F.col("h") < F.col("below")).cast("long"))
        .select("doc_id", "source", "size", "source_size", "target", "copies", (F.col("size") * F.col("copies")).alias("taken"))
    )


def mix(docs: DataFrame) -> DataFrame:
    """docs as mixed: each row as often as it is taken, so some rows not at all and some twice."""
    slim = durable(docs.select("source", hash60(F.col("doc_id")).alias("h"), words().alias("size")), "sizes")
    cuts = decide(slim)
    of, base, below, copy = (unused(docs, c) for c in ("source", "base", "below", "copy"))
    cuts = cuts.select(F.col("source").alias(of), F.col("base").alias(base), F.col("below").alias(below))
    copies = F.col(base) + (hash60(F.col("doc_id")) < F.col(below)).cast("long")
    out = docs.join(cuts, F.col("source").eqNullSafe(F.col(of))).withColumn(copy, F.explode(F.array_repeat(F.lit(1), copies.cast("int"))))
    return out.select(*[F.col(f"`{c}`") for c in docs.columns])


ORACLE = r"""
WITH d AS (
  SELECT doc_id, source, COALESCE(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
         ('0x' || left(md5(COALESCE(CAST(doc_id AS VARCHAR), '')), 15))::BIGINT AS h
  FROM documents),
s AS (SELECT source, SUM(size)::BIGINT AS source_size FROM d GROUP BY source),
n AS (SELECT *, ([5.0, 2.0, 1.0])[((ROW_NUMBER() OVER (ORDER BY source COLLATE C NULLS LAST) - 1) % 3 + 1)::INT]::DOUBLE AS w FROM s),
o AS (
  SELECT *, ROW_NUMBER() OVER (ORDER BY 2.0 * source_size / w, source) AS r FROM n),
l AS (
  SELECT *, ((SELECT SUM(source_size) FROM n) * 1.5 - COALESCE(SUM(2.0 * source_size) OVER (ORDER BY r ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
            / SUM(w) OVER (ORDER BY r ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM o),
f AS (SELECT level FROM l WHERE level * w < 2.0 * source_size ORDER BY r LIMIT 1),
t AS (SELECT source, source_size, COALESCE(LEAST(2.0 * source_size, (SELECT level FROM f) * w), 2.0 * source_size)::DOUBLE AS target FROM l),
b AS (SELECT *, CASE WHEN source_size > 0 THEN FLOOR(target / source_size)::BIGINT ELSE 0 END AS base FROM t),
g AS (
  SELECT d.source, h, SUM(size) AS hs, SUM(SUM(size)) OVER (PARTITION BY d.source ORDER BY h) - SUM(size) AS before
  FROM d GROUP BY d.source, h)
SELECT d.doc_id, d.size, b.source_size, b.target,
       (d.size * (b.base + CASE WHEN 2 * g.before + g.hs <= 2 * (b.target - b.base * b.source_size) THEN 1 ELSE 0 END))::BIGINT AS taken
FROM d JOIN b ON d.source IS NOT DISTINCT FROM b.source
JOIN g ON d.source IS NOT DISTINCT FROM g.source AND d.h = g.h
"""
