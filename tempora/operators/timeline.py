"""System and valid time over append-only version logs.

A History is a log of versions (key, sys_from, seq, columns..., [valid_from, valid_to], [_prov_*]) and a log of
retractions (key, sys_from, seq, closed_at) that close the version they name. The end of a version's system interval is
never stored: it is its retraction or its successor's start, whichever comes first. Instants are bigint microseconds,
intervals half-open; FOREVER means open and is shown as null.

Compaction seals versions whose end is known: `sealed` holds them with sys_to, and a read of them is a filter on both bounds,
without a shuffle. What is left in the log, the versions that were open and those since, is resolved: a read as of S filters
sys_from <= S on the stored column below the aggregate, so Parquet statistics prune files and row groups, and only the columns
asked for are carried through max_by.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

FOREVER = (1 << 63) - 1
BEGINNING = -(1 << 63)
PROVENANCE = ("_prov_txn_id", "_prov_committed_at", "_prov_principal")


class TemporalError(ValueError):
    """A temporal request that is rejected before any plan is made."""


class BeforeHistory(TemporalError):
    """A read as of an instant before the first commit."""


@dataclass(frozen=True)
class History:
    versions: DataFrame
    key: str
    columns: tuple[str, ...]  # user columns in order, the key included
    retractions: DataFrame | None = None
    valid: bool = False
    sealed: DataFrame | None = None

    def with_logs(self, versions: DataFrame, retractions: DataFrame | None) -> History:
        return replace(self, versions=versions, retractions=retractions)

    def carried(self, columns=None) -> list[str]:
        own = [c for c in (columns or self.columns) if c != self.key]
        hidden = [c for c in PROVENANCE if c in self.versions.columns]
        return own + (["valid_from", "valid_to"] if self.valid else []) + hidden


def as_of(h: History, at: int, valid_at: int | None = None, columns=None, hidden: bool = False) -> DataFrame:
    """The version of each key that is live at system time `at`; with valid_at also true at that valid time.

    Only the greatest (sys_from, seq) not after `at` can be live, so one aggregate with map-side partials finds it and
    an anti join drops it if its retraction had come. The valid filter follows the resolution, never precedes it.
    """
    if valid_at is not None and not h.valid:
        raise TemporalError("valid time asked of a table without a valid axis")
    carried = h.carried(columns)
    seen = h.versions.where(F.col("sys_from") <= F.lit(at))
    order = F.struct("sys_from", "seq")
    latest = seen.groupBy(h.key).agg(
        F.max_by(F.struct("sys_from", "seq", *carried), order).alias("_v")
    ).select(h.key, "_v.*")
    if h.retractions is not None:
        closed = h.retractions.where(F.col("closed_at") <= F.lit(at)).select(h.key, "sys_from", "seq")
        latest = latest.join(closed, [h.key, "sys_from", "seq"], "left_anti")
    if valid_at is not None:
        latest = latest.where((F.col("valid_from") <= F.lit(valid_at)) & (F.col("valid_to") > F.lit(valid_at)))
    out = [c for c in (columns or h.columns)]
    if hidden:
        out += [c for c in latest.columns if c not in out]
    latest = latest.select(*out)
    if h.sealed is None:
        return latest
    closed = h.sealed.where((F.col("sys_from") <= F.lit(at)) & (F.col("sys_to") > F.lit(at)))
    if valid_at is not None:
        closed = closed.where((F.col("valid_from") <= F.lit(valid_at)) & (F.col("valid_to") > F.lit(valid_at)))
    return latest.unionByName(closed.select(*out))


def endpoints(h: History, columns=None, slice_us: int | None = None, degenerate: bool = False) -> DataFrame:
    """All versions with sys_from and sys_to; versions overwritten in the same tick are left out unless `degenerate`.

    slice_us: for keys with very many versions. The successor is then found within slices of that much system time,
    and a slice's last version takes the first start of the key's next slice, so no task holds a whole key.
    """
    carried = h.carried(columns)
    rows = h.versions.select(h.key, "sys_from", "seq", *carried)
    if slice_us is None:
        rows = rows.withColumn("_next", F.lead("sys_from").over(W.partitionBy(h.key).orderBy("sys_from", "seq")))
    else:
        cut = F.floor(F.col("sys_from") / F.lit(slice_us)).cast("long")
        rows = rows.withColumn("_slice", cut)
        firsts = rows.groupBy(h.key, "_slice").agg(F.min("sys_from").alias("_first"))
        after = firsts.withColumn("_after", F.lead("_first").over(W.partitionBy(h.key).orderBy("_slice"))).drop("_first")
        rows = rows.withColumn("_in", F.lead("sys_from").over(W.partitionBy(h.key, "_slice").orderBy("sys_from", "seq")))
        on = rows[h.key].eqNullSafe(after[h.key]) & (rows["_slice"] == after["_slice"])
        rows = rows.join(after.drop(), on, "left").select(
            rows[h.key], "sys_from", "seq", *carried, F.coalesce("_in", "_after").alias("_next")
        )
    if h.retractions is not None:
        closed = h.retractions.groupBy(h.key, "sys_from", "seq").agg(F.min("closed_at").alias("_closed"))
        rows = rows.join(closed, [h.key, "sys_from", "seq"], "left")
    else:
        rows = rows.withColumn("_closed", F.lit(None).cast("long"))
    end = F.least(F.coalesce("_closed", F.lit(FOREVER)), F.coalesce("_next", F.lit(FOREVER)))
    rows = rows.withColumn("sys_to", end).drop("_next", "_closed")
    if h.sealed is not None:
        rows = rows.unionByName(h.sealed.select(h.key, "sys_from", "seq", *carried, "sys_to"))
    return rows if degenerate else rows.where("sys_from < sys_to")


def overlap(start: Column, end: Column, low: int, high: int, closed: bool) -> Column:
    """Whether [start, end) meets [low, high), or [low, high] if closed: only the asked interval's end closes."""
    check_range(low, high, closed)
    return (end > F.lit(low)) & ((start <= F.lit(high)) if closed else (start < F.lit(high)))


def check_range(low: int, high: int, closed: bool) -> None:
    if low > high or (low == high and not closed):
        raise TemporalError(f"empty range: {low} to {high}")


def system_range(h: History, low: int, high: int, closed: bool = False, columns=None, raw: bool = False, slice_us=None) -> DataFrame:
    """Versions whose system interval meets the range, with sys_from and sys_to (raw keeps FOREVER)."""
    rows = endpoints(h, columns, slice_us).where(overlap(F.col("sys_from"), F.col("sys_to"), low, high, closed))
    rows = rows.select(*(columns or h.columns), "sys_from", "sys_to")
    return rows if raw else shown(rows, "sys_to")


def valid_range(h: History, at: int, low: int, high: int, closed: bool = False, columns=None, raw: bool = False) -> DataFrame:
    """Versions live at system time `at` whose valid interval meets the range, with valid_from and valid_to."""
    if not h.valid:
        raise TemporalError("valid time asked of a table without a valid axis")
    rows = as_of(h, at, columns=columns, hidden=True)
    rows = rows.where(overlap(F.col("valid_from"), F.col("valid_to"), low, high, closed))
    rows = rows.select(*(columns or h.columns), "valid_from", "valid_to")
    return rows if raw else shown(rows, "valid_to")


def shown(rows: DataFrame, *ends: str) -> DataFrame:
    """FOREVER as null."""
    return rows.withColumns({c: F.when(F.col(c) != FOREVER, F.col(c)) for c in ends})


def history(h: History, key_value=None, now: int = FOREVER) -> DataFrame:
    """(op, sys_from, sys_to, current, provenance, columns...): every version, INSERT or UPDATE by whether it follows on."""
    if key_value is not None:
        own = F.col(h.key) == F.lit(key_value)
        h = replace(h, versions=h.versions.where(own), sealed=None if h.sealed is None else h.sealed.where(own))
    rows = endpoints(h)
    before = F.lag("sys_to").over(W.partitionBy(h.key).orderBy("sys_from", "seq"))
    rows = rows.withColumn("op", F.when(before == F.col("sys_from"), "UPDATE").otherwise("INSERT"))
    rows = rows.withColumn("current", (F.col("sys_to") == FOREVER) & (F.col("sys_from") <= F.lit(now)))
    hidden = [c for c in PROVENANCE if c in rows.columns]
    return shown(rows.select("op", "sys_from", "sys_to", "current", *hidden, *h.columns), "sys_to")
