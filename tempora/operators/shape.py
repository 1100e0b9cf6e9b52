"""Sorting, limits and aggregates with the engine's rules where they differ from Spark's defaults."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def order_by(df: DataFrame, *keys: str) -> DataFrame:
    """keys: "col" or "col DESC". Nulls come last ascending and first descending."""
    def one(key: str) -> Column:
        name, _, way = key.strip().partition(" ")
        return F.col(name).desc_nulls_first() if way.strip().upper() == "DESC" else F.col(name).asc_nulls_last()

    return df.orderBy(*[one(k) for k in keys])


def limit(df: DataFrame, count: int | None = None, offset: int = 0) -> DataFrame:
    """OFFSET then LIMIT; None is LIMIT ALL; an offset past the end leaves nothing."""
    if offset < 0 or (count is not None and count < 0):
        raise ValueError("LIMIT and OFFSET take counts that are not negative")
    df = df.offset(offset) if offset else df
    return df if count is None else df.limit(count)


def sum_int(column: str) -> Column:
    """SUM of integers as bigint; a sum that does not fit is null."""
    total = F.sum(F.col(column).cast("decimal(38,0)"))
    fits = total.between(F.lit(-(1 << 63)).cast("decimal(38,0)"), F.lit((1 << 63) - 1).cast("decimal(38,0)"))
    return F.when(fits, total.cast("long"))


AGGREGATES = {
    "count": lambda c: F.count(F.lit(1) if c == "*" else F.col(c)),
    "sum": sum_int,
    "avg": lambda c: F.avg(F.col(c)),
    "min": lambda c: F.min(F.col(c)),
    "max": lambda c: F.max(F.col(c)),
}


def aggregate(df: DataFrame, keys: list[str], aggs: dict[str, tuple[str, str]], having: Column | None = None) -> DataFrame:
    """aggs: output name -> (function, column or *). Null keys form a group; without keys one row always comes."""
    columns = [AGGREGATES[f.lower()](c).alias(name) for name, (f, c) in aggs.items()]
    out = df.groupBy(*keys).agg(*columns) if keys else df.agg(*columns)
    return out if having is None else out.where(having)
