"""Temporal joins: at one point over every input, or over intervals (sequenced).

Interval joins pair rows by an equality and combine their periods: INNER intersects; LEFT keeps the intersections and
extends the left row with nulls over each maximal gap; SEMI keeps the left row over the joined-up covered parts; ANTI
over the gaps. Matches are found by one equi-join; gaps and islands by one window over a left row's matches. For keys with many rows on both
sides the equality can take a slice of time beside the key, so rows of one key that are far apart in time never meet.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .timeline import BEGINNING, FOREVER, History, TemporalError, as_of, overlap


def at_point(inputs: list[History], at: int, valid_at: int | None = None) -> list[DataFrame]:
    """Every input as of the same instants, ready for any join."""
    if valid_at is not None and not all(h.valid for h in inputs):
        raise TemporalError("a valid-time pin needs a valid axis on every input")
    return [as_of(h, at, valid_at) for h in inputs]


def timeless(df: DataFrame, start: str = "sys_from", end: str = "sys_to") -> DataFrame:
    """A relation without a time axis, live always: for INNER steps only."""
    return df.withColumns({start: F.lit(BEGINNING), end: F.lit(FOREVER)})


def interval_join(
    left: DataFrame,
    right: DataFrame,
    on: tuple[str, str],
    how: str = "inner",
    ends: tuple[str, str] = ("sys_from", "sys_to"),
    identity: list[str] | None = None,
    slices: int | None = None,
) -> DataFrame:
    """left and right hold the period in the columns `ends` (no nulls; open is FOREVER) and no other common names.

    identity: columns that tell left rows apart; rows are numbered if none are given. Output: left columns, right columns (INNER
    and LEFT), and the output's period in `ends`.

    slices: for keys with many rows on both sides. Time is cut where the starts of both sides have their quantiles (one pass
    over them, `slices` - 1 numbers to the driver), each row is dealt to the slices its period meets, and a pair is made in the
    first slice its two rows share, so once. A row is copied at most `slices` times; one of a short period once or twice.
    """
    how = how.lower().replace("left_", "")
    start, end = ends
    lcols = [c for c in left.columns if c not in ends]
    rcols = [c for c in right.columns if c not in ends]
    if clash := set(lcols) & set(rcols):
        raise TemporalError(f"ambiguous column names in an interval join: {sorted(clash)}")
    if how not in ("inner", "left", "semi", "anti"):
        raise TemporalError(f"no interval form of a {how} join")
    if how != "inner" and not identity:
        left = left.withColumn("_lid", F.monotonically_increasing_id())
    kept = left.columns
    r = right.withColumnsRenamed({start: "_rf", end: "_rt"})
    cuts = quantiles(left, right, start, slices) if slices and slices > 1 else []
    if cuts:
        left, r = dealt(left, cuts, start, end, "_l"), dealt(r, cuts, "_rf", "_rt", "_r")
    met = (left[on[0]] == r[on[1]]) & (r["_rf"] < left[end]) & (r["_rt"] > left[start])
    if cuts:
        met &= (left["_lslice"] == r["_rslice"]) & (left["_lslice"] == F.greatest(left["_lfirst"], r["_rfirst"]))
    if how == "inner":
        return left.join(r, met).select(
            *[left[c] for c in lcols],
            *[r[c] for c in rcols],
            F.greatest(left[start], r["_rf"]).alias(start),
            F.least(left[end], r["_rt"]).alias(end),
        )
    ids = [*(identity or ["_lid"]), start, end]
    j = left.join(r, met, "left")
    if cuts:  # a row without a match in a slice stands for itself in its first slice only
        j = j.where(r["_rf"].isNotNull() | (left["_lslice"] == left["_lfirst"]))
    j = j.select(
        *[left[c] for c in kept],
        *([r[c] for c in rcols] if how == "left" else []),
        F.greatest(left[start], r["_rf"]).alias("_cf"),
        F.least(left[end], r["_rt"]).alias("_ct"),
        r["_rf"].isNotNull().alias("_hit"),
    )
    j = j.withColumns({c: F.when(F.col("_hit"), F.col(c)) for c in ("_cf", "_ct")})
    if cuts:
        j = j.withColumn("_any", F.max("_hit").over(W.partitionBy(*ids))).where(F.col("_hit") | ~F.col("_any")).drop("_any")
    order = W.partitionBy(*ids).orderBy("_cf", "_ct")
    before = F.max("_ct").over(order.rowsBetween(W.unboundedPreceding, -1))
    j = j.withColumn("_max", before)
    if how == "semi":
        j = j.where("_hit").withColumn("_new", (F.col("_max").isNull() | (F.col("_cf") > F.col("_max"))).cast("int"))
        j = j.withColumn("_island", F.sum("_new").over(order.rowsBetween(W.unboundedPreceding, 0)))
        keep = [c for c in lcols if c not in ids]
        out = j.groupBy(*ids, "_island").agg(
            F.min("_cf").alias("_f"), F.max("_ct").alias("_t"), *[F.first(c).alias(c) for c in keep]
        )
        return out.select(*lcols, F.col("_f").alias(start), F.col("_t").alias(end))
    last = F.lead(F.lit(1)).over(order).isNull()
    j = j.withColumn("_last", last)
    floor = F.coalesce("_max", F.col(start))
    gap = F.struct(floor.alias("f"), F.coalesce("_cf", F.col(end)).alias("t"), F.lit(False).alias("hit"))
    tail = F.struct(F.greatest(F.coalesce("_max", F.col(start)), "_ct").alias("f"), F.col(end).alias("t"), F.lit(False).alias("hit"))
    own = F.struct(F.col("_cf").alias("f"), F.col("_ct").alias("t"), F.lit(True).alias("hit"))
    parts = [F.when(gap["f"] < gap["t"], gap), F.when(F.col("_hit") & F.col("_last") & (tail["f"] < tail["t"]), tail)]
    if how == "left":
        parts.append(F.when(F.col("_hit"), own))
    j = j.withColumn("_p", F.explode(F.filter(F.array(*parts), lambda p: p.isNotNull())))
    rights = [F.when(F.col("_p.hit"), F.col(c)).alias(c) for c in rcols] if how == "left" else []
    return j.select(*lcols, *rights, F.col("_p.f").alias(start), F.col("_p.t").alias(end))


def quantiles(left: DataFrame, right: DataFrame, start: str, slices: int) -> list[int]:
    """At most slices - 1 instants that cut the starts of both sides into like shares."""
    shares = [i / slices for i in range(1, slices)]
    starts = left.select(start).unionAll(right.select(start))
    got = starts.agg(F.percentile_approx(start, shares, 10 * slices)).first()[0]
    return sorted(set(got or []))


def dealt(df: DataFrame, cuts: list[int], start: str, end: str, prefix: str) -> DataFrame:
    """df once for each slice its period meets: the slice's number, and that of its first. An empty period is in one slice."""
    edges = F.array(*[F.lit(c).cast("long") for c in cuts])
    first = F.size(F.filter(edges, lambda c: c <= F.col(start)))
    last = F.greatest(first, F.size(F.filter(edges, lambda c: c < F.col(end))))
    df = df.withColumn(f"{prefix}first", first)
    return df.withColumn(f"{prefix}slice", F.explode(F.sequence(F.col(f"{prefix}first"), last)))


def in_window(rows: DataFrame, low: int, high: int, closed: bool = False, ends: tuple[str, str] = ("sys_from", "sys_to")) -> DataFrame:
    """The rows whose period meets the asked window; periods are not clipped to it."""
    return rows.where(overlap(F.col(ends[0]), F.col(ends[1]), low, high, closed))
