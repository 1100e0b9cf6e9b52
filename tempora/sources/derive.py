"""Deterministic histories over the test tables, each with a twin for DuckDB.

The logs keep their instants as bigint microseconds, so a filter on sys_from is a filter on stored values once a log is
written (write_log); derived straight from a table, the same instant is also filtered on the raw timestamp.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..operators.timeline import FOREVER, History

DAY = 86_400_000_000
HOUR = 3_600_000_000


def micros(ts: str) -> Column:
    return F.unix_micros(F.col(ts).cast("timestamp"))


def cents(money: str) -> Column:
    return F.round(F.col(money) * 100).cast("long")


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def orders_history(spark: SparkSession, sf_dir: str) -> History:
    """Key o_custkey: a customer's latest order. Some orders are retracted halfway to their successor."""
    base = _table(spark, sf_dir, "orders").select(
        "o_custkey",
        micros("o_orderdate").alias("sys_from"),
        F.col("o_orderkey").alias("seq"),
        "o_orderkey",
        "o_orderstatus",
        cents("o_totalprice").alias("price_cents"),
    )
    after = F.lead("sys_from").over(W.partitionBy("o_custkey").orderBy("sys_from", "seq"))
    gone = (
        base.withColumn("_next", after)
        .where((F.col("o_orderstatus") == "F") & (F.col("o_orderkey") % 5 == 0))
        .withColumn("closed_at", F.col("sys_from") + F.coalesce(F.expr("(_next - sys_from) div 2"), F.lit(30 * DAY)))
        .select("o_custkey", "sys_from", "seq", "closed_at")
    )
    return History(base, "o_custkey", ("o_custkey", "o_orderkey", "o_orderstatus", "price_cents"), gone)


ORDERS = f"""
ob AS (SELECT o_custkey, epoch_us(o_orderdate) AS sys_from, o_orderkey AS seq, o_orderkey, o_orderstatus,
              CAST(ROUND(o_totalprice * 100) AS BIGINT) AS price_cents FROM orders),
ol AS (SELECT *, LEAD(sys_from) OVER (PARTITION BY o_custkey ORDER BY sys_from, seq) AS nxt FROM ob),
ov AS (SELECT *, LEAST(COALESCE(nxt, {FOREVER}),
         CASE WHEN o_orderstatus = 'F' AND o_orderkey % 5 = 0 THEN sys_from + COALESCE((nxt - sys_from) // 2, {30 * DAY}) ELSE {FOREVER} END) AS sys_to FROM ol),
oh AS (SELECT * FROM ov WHERE sys_from < sys_to)"""


def parts_history(spark: SparkSession, sf_dir: str) -> History:
    """Key l_partkey: a part's latest shipment, true for as many days as its quantity."""
    start = micros("l_shipdate")
    base = _table(spark, sf_dir, "lineitem").select(
        "l_partkey",
        start.alias("sys_from"),
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("seq"),
        "l_suppkey",
        F.col("l_quantity").cast("int").alias("qty"),
        start.alias("valid_from"),
        F.when(F.col("l_linenumber") % 4 == 0, F.lit(FOREVER)).otherwise(start + F.col("l_quantity").cast("long") * DAY).alias("valid_to"),
    )
    return History(base, "l_partkey", ("l_partkey", "l_suppkey", "qty"), None, True)


PARTS = f"""
pb AS (SELECT l_partkey, epoch_us(l_shipdate) AS sys_from, l_orderkey * 10 + l_linenumber AS seq, l_suppkey, CAST(l_quantity AS INT) AS qty,
              epoch_us(l_shipdate) AS valid_from,
              CASE WHEN l_linenumber % 4 = 0 THEN {FOREVER} ELSE epoch_us(l_shipdate) + CAST(l_quantity AS BIGINT) * {DAY} END AS valid_to FROM lineitem),
pv AS (SELECT *, COALESCE(LEAD(sys_from) OVER (PARTITION BY l_partkey ORDER BY sys_from, seq), {FOREVER}) AS sys_to FROM pb),
ph AS (SELECT * FROM pv WHERE sys_from < sys_to)"""


def events_history(spark: SparkSession, sf_dir: str) -> History:
    """Key user_id: a user's latest event; an error ends an hour later if nothing came before."""
    base = _table(spark, sf_dir, "events").select(
        "user_id", micros("ts").alias("sys_from"), F.col("event_id").alias("seq"), "event_type", F.floor("value").cast("int").alias("value")
    )
    gone = base.where(F.col("event_type") == "error").select("user_id", "sys_from", "seq", (F.col("sys_from") + HOUR).alias("closed_at"))
    return History(base, "user_id", ("user_id", "event_type", "value"), gone)


EVENTS = f"""
eb AS (SELECT user_id, epoch_us(ts) AS sys_from, event_id AS seq, event_type, CAST(FLOOR(value) AS INT) AS value FROM events),
ev AS (SELECT *, LEAST(COALESCE(LEAD(sys_from) OVER (PARTITION BY user_id ORDER BY sys_from, seq), {FOREVER}),
                       CASE WHEN event_type = 'error' THEN sys_from + {HOUR} ELSE {FOREVER} END) AS sys_to FROM eb),
eh AS (SELECT * FROM ev WHERE sys_from < sys_to)"""


def write_log(h: History, path: str) -> History:
    """The history as stored logs: version files in key and time order, so both filters prune."""
    spark = h.versions.sparkSession
    h.versions.repartitionByRange(h.key, "sys_from").sortWithinPartitions(h.key, "sys_from").write.parquet(f"{path}/versions")
    gone = None
    if h.retractions is not None:
        h.retractions.write.parquet(f"{path}/retractions")
        gone = spark.read.parquet(f"{path}/retractions")
    return h.with_logs(spark.read.parquet(f"{path}/versions"), gone)
