"""Registered queries of the engine's operators, each with its SQL for DuckDB."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import numeric
from .functions.hashkey import hash_key
from .operators import periods, shape, timeline, tjoin
from .sources import derive
from .sources.files import shared_folder

#: Instants in the test tables' years, microseconds.
T1, T2, T3 = 820_454_400_000_000, 883_612_800_000_000, 852_076_800_000_000  # 1996-01-01, 1998-01-01, 1997-01-01
E1, E2 = 1_704_400_000_000_000, 1_705_000_000_000_000

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return keep


def _t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


O, P, E = derive.ORDERS, derive.PARTS, derive.EVENTS
LIVE = "sys_from <= {0} AND sys_to > {0}"


@query(f"WITH {O} SELECT o_orderstatus, COUNT(*) AS n FROM oh WHERE {LIVE.format(T1)} GROUP BY o_orderstatus")
def asof_status_counts(spark, sf_dir):
    live = timeline.as_of(derive.orders_history(spark, sf_dir), T1, columns=["o_custkey", "o_orderstatus"])
    return live.groupBy("o_orderstatus").agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {O} SELECT o_custkey, o_orderkey, o_orderstatus, price_cents FROM oh WHERE {LIVE.format(T1)}")
def system_as_of(spark, sf_dir):
    return timeline.as_of(derive.orders_history(spark, sf_dir), T1)


@query(f"WITH {P} SELECT l_partkey, l_suppkey, qty FROM ph WHERE {LIVE.format(T3)} AND valid_from <= {T3} AND valid_to > {T3}")
def bitemporal_as_of(spark, sf_dir):
    return timeline.as_of(derive.parts_history(spark, sf_dir), T3, T3)


SHOW = "CASE WHEN {0} < 9223372036854775807 THEN {0} END AS {0}"


@query(f"WITH {O} SELECT o_custkey, o_orderkey, o_orderstatus, price_cents, sys_from, {SHOW.format('sys_to')} FROM oh WHERE sys_to > {T1} AND sys_from < {T3}")
def system_range_from_to(spark, sf_dir):
    return timeline.system_range(derive.orders_history(spark, sf_dir), T1, T3)


@query(f"WITH {E} SELECT user_id, event_type, value, sys_from, {SHOW.format('sys_to')} FROM eh WHERE sys_to > {E1} AND sys_from <= {E2}")
def system_range_between(spark, sf_dir):
    return timeline.system_range(derive.events_history(spark, sf_dir), E1, E2, closed=True, slice_us=derive.DAY)


@query(
    f"WITH {P} SELECT l_partkey, l_suppkey, qty, valid_from, {SHOW.format('valid_to')} FROM ph WHERE {LIVE.format(T2)} AND valid_to > {T1} AND valid_from < {T3}"
)
def valid_range_from_to(spark, sf_dir):
    return timeline.valid_range(derive.parts_history(spark, sf_dir), T2, T1, T3)


@query(
    f"""WITH {O}, h AS (SELECT *, LAG(sys_to) OVER (PARTITION BY o_custkey ORDER BY sys_from, seq) AS p FROM oh)
SELECT CASE WHEN p = sys_from THEN 'UPDATE' ELSE 'INSERT' END AS op, sys_from, {SHOW.format('sys_to')}, sys_to = 9223372036854775807 AS current,
       o_custkey, o_orderkey, o_orderstatus, price_cents FROM h"""
)
def history_timeline(spark, sf_dir):
    return timeline.history(derive.orders_history(spark, sf_dir))


PRED = [("CONTAINS", "a <= c AND d <= b"), ("OVERLAPS", "a < d AND c < b"), ("EQUALS", "a = c AND b = d"), ("PRECEDES", "b <= c"),
        ("SUCCEEDS", "d <= a"), ("IMMEDIATELY PRECEDES", "b = c"), ("IMMEDIATELY SUCCEEDS", "a = d")]


@query(
    f"WITH {P}, x AS (SELECT valid_from AS a, valid_to AS b, {T1}::BIGINT AS c, {T3}::BIGINT AS d FROM pb) "
    + " UNION ALL ".join(f"SELECT '{n}' AS predicate, COUNT(*) AS n FROM x WHERE a < b AND {w}" for n, w in PRED)
)
def period_predicates(spark, sf_dir):
    rows = derive.parts_history(spark, sf_dir).versions.select("valid_from", "valid_to")
    tests = [F.sum(periods.compare(("valid_from", "valid_to"), n, (T1, T3)).cast("int")).alias(n) for n, _ in PRED]
    one = rows.agg(*[F.coalesce(t, F.lit(0)).alias(n) for t, (n, _) in zip(tests, PRED, strict=True)])
    return one.unpivot([], [n for n, _ in PRED], "predicate", "n")


@query(
    """SELECT l_orderkey, l_linenumber, TRY(a + b) AS plus, TRY(a - b) AS minus, TRY(a * b) AS times,
CASE WHEN b <> 0 THEN a // b END AS over, CASE WHEN b <> 0 THEN a % b END AS rest
FROM (SELECT l_orderkey, l_linenumber, CAST(l_quantity AS BIGINT) * 184467440737095516 - 5 AS a, CAST(l_linenumber % 3 AS BIGINT) * 7 AS b FROM lineitem)"""
)
def safe_arithmetic(spark, sf_dir):
    rows = _t(spark, sf_dir, "lineitem").select(
        "l_orderkey",
        "l_linenumber",
        (F.col("l_quantity").cast("long") * F.lit(184467440737095516) - 5).alias("a"),
        ((F.col("l_linenumber") % 3).cast("long") * 7).alias("b"),
    )
    a, b = F.col("a"), F.col("b")
    return rows.select(
        "l_orderkey", "l_linenumber", numeric.add(a, b).alias("plus"), numeric.subtract(a, b).alias("minus"), numeric.multiply(a, b).alias("times"),
        numeric.divide(a, b).alias("over"), numeric.modulo(a, b).alias("rest"),
    )


@query(
    """SELECT o_custkey, COUNT(*) AS n, CAST(SUM(CAST(ROUND(o_totalprice * 100) AS BIGINT)) AS BIGINT) AS total,
AVG(CAST(ROUND(o_totalprice * 100) AS BIGINT)) AS mean, MIN(o_orderkey) AS lo, MAX(o_orderpriority) AS hi
FROM orders GROUP BY o_custkey HAVING SUM(CAST(ROUND(o_totalprice * 100) AS BIGINT)) > 20 * MAX(CAST(ROUND(o_totalprice * 100) AS BIGINT)) // 10"""
)
def aggregates_having(spark, sf_dir):
    rows = _t(spark, sf_dir, "orders").withColumn("c", derive.cents("o_totalprice"))
    out = shape.aggregate(
        rows,
        ["o_custkey"],
        {"n": ("count", "*"), "total": ("sum", "c"), "mean": ("avg", "c"), "lo": ("min", "o_orderkey"), "hi": ("max", "o_orderpriority"), "most": ("max", "c")},
        numeric.divide(F.lit(20) * F.col("most"), F.lit(10)) < F.col("total"),
    )
    return out.drop("most")


@query("SELECT DISTINCT o_orderstatus, o_orderpriority FROM orders ORDER BY 1 DESC, 2 LIMIT 7 OFFSET 2")
def distinct_order_limit(spark, sf_dir):
    rows = _t(spark, sf_dir, "orders").select("o_orderstatus", "o_orderpriority").distinct()
    return shape.limit(shape.order_by(rows, "o_orderstatus DESC", "o_orderpriority"), 7, 2)


@query("SELECT c_custkey, n_name, r_name FROM customer JOIN nation ON c_nationkey = n_nationkey LEFT JOIN region ON n_regionkey = r_regionkey")
def join_chain(spark, sf_dir):
    c, n, r = (_t(spark, sf_dir, t) for t in ("customer", "nation", "region"))
    return c.join(n, c.c_nationkey == n.n_nationkey).join(r, n.n_regionkey == r.r_regionkey, "left").select("c_custkey", "n_name", "r_name")


@query("SELECT c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)")
def semi_join(spark, sf_dir):
    c, o = _t(spark, sf_dir, "customer"), _t(spark, sf_dir, "orders")
    return c.join(o, c.c_custkey == o.o_custkey, "left_semi").select("c_custkey")


@query("SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'P')")
def anti_join(spark, sf_dir):
    c, o = _t(spark, sf_dir, "customer"), _t(spark, sf_dir, "orders").where("o_orderstatus = 'P'")
    return c.join(o, c.c_custkey == o.o_custkey, "left_anti").select("c_custkey")


SUBQUERIES = """WITH big AS (SELECT o_custkey AS k, COUNT(*) AS n FROM orders GROUP BY o_custkey)
SELECT c_custkey, (SELECT MAX(n) FROM big) AS most, (SELECT n FROM big WHERE k = c_custkey) AS own
FROM customer
WHERE c_custkey IN (SELECT k FROM big WHERE n > 1) AND c_nationkey NOT IN (SELECT n_nationkey FROM nation WHERE n_regionkey = 0)
  AND EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'O')"""


@query(SUBQUERIES)
def subqueries_and_ctes(spark, sf_dir):
    return _session(spark, **{t: _t(spark, sf_dir, t) for t in ("orders", "customer", "nation")}).sql(SUBQUERIES)


@query(
    f"""WITH {O}, {E} SELECT o_custkey, o_orderkey, event_type FROM oh JOIN eh ON o_custkey = user_id
WHERE oh.sys_from <= {E1} AND oh.sys_to > {E1} AND eh.sys_from <= {E1} AND eh.sys_to > {E1}"""
)
def point_temporal_join(spark, sf_dir):
    o, e = tjoin.at_point([derive.orders_history(spark, sf_dir), derive.events_history(spark, sf_dir)], E1)
    return o.join(e, o.o_custkey == e.user_id).select("o_custkey", "o_orderkey", "event_type")


def _sides(spark, sf_dir):
    """Orders and, by the same customers, another history: each range-scanned first, as a range join asks."""
    left = timeline.system_range(derive.orders_history(spark, sf_dir), T1, T2, raw=True, columns=["o_custkey", "o_orderkey"])
    right = timeline.endpoints(_shifted(spark, sf_dir))
    right = tjoin.in_window(right, T1, T2).select("k", F.col("o_orderstatus").alias("status"), "sys_from", "sys_to")
    return left, right


def _shifted(spark, sf_dir):
    h = derive.orders_history(spark, sf_dir)
    rows = h.versions.select((F.col("o_custkey") + 1).alias("k"), "sys_from", "seq", "o_orderstatus")
    gone = h.retractions.select((F.col("o_custkey") + 1).alias("k"), "sys_from", "seq", "closed_at")
    return timeline.History(rows, "k", ("k", "o_orderstatus"), gone)


PAIRS = f"""WITH {O},
l AS (SELECT o_custkey, o_orderkey, sys_from AS lf, sys_to AS lt FROM oh WHERE sys_to > {T1} AND sys_from < {T2}),
r AS (SELECT o_custkey + 1 AS k, o_orderstatus AS status, sys_from AS rf, sys_to AS rt FROM oh WHERE sys_to > {T1} AND sys_from < {T2}),
m AS (SELECT l.*, k, status, GREATEST(lf, rf) AS cf, LEAST(lt, rt) AS ct FROM l LEFT JOIN r ON o_custkey = k AND rf < lt AND rt > lf),
w AS (SELECT *, MAX(CASE WHEN k IS NOT NULL THEN ct END) OVER (PARTITION BY o_custkey, o_orderkey, lf ORDER BY cf, ct ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS rm FROM m),
hit AS (SELECT * FROM w WHERE k IS NOT NULL),
isl AS (SELECT *, SUM(CASE WHEN rm IS NULL OR cf > rm THEN 1 ELSE 0 END) OVER (PARTITION BY o_custkey, o_orderkey, lf ORDER BY cf, ct ROWS UNBOUNDED PRECEDING) AS i FROM hit),
cov AS (SELECT o_custkey, o_orderkey, lf, lt, i, MIN(cf) AS f, MAX(ct) AS t FROM isl GROUP BY ALL),
gaps AS (
  SELECT o_custkey, o_orderkey, COALESCE(LAG(t) OVER (PARTITION BY o_custkey, o_orderkey, lf ORDER BY f), lf) AS f, f AS t FROM cov
  UNION ALL SELECT o_custkey, o_orderkey, MAX(t), ANY_VALUE(lt) FROM cov GROUP BY o_custkey, o_orderkey, lf
  UNION ALL SELECT o_custkey, o_orderkey, lf, lt FROM m WHERE k IS NULL)
"""
KEEP = f"t > {T1} AND f < {T2} AND f < t"


@query(f"{PAIRS} SELECT o_custkey, o_orderkey, k, status, cf AS sys_from, {SHOW.format('ct').replace('AS ct', 'AS sys_to')} FROM hit WHERE ct > {T1} AND cf < {T2}")
def interval_join_inner(spark, sf_dir):
    left, right = _sides(spark, sf_dir)
    return timeline.shown(tjoin.in_window(tjoin.interval_join(left, right, ("o_custkey", "k"), "inner"), T1, T2), "sys_to")


@query(
    f"{PAIRS} SELECT o_custkey, o_orderkey, k, status, cf AS sys_from, {SHOW.format('ct').replace('AS ct', 'AS sys_to')} FROM hit WHERE ct > {T1} AND cf < {T2} "
    f"UNION ALL SELECT o_custkey, o_orderkey, NULL, NULL, f, CASE WHEN t < 9223372036854775807 THEN t END FROM gaps WHERE {KEEP}"
)
def interval_join_left(spark, sf_dir):
    left, right = _sides(spark, sf_dir)
    return timeline.shown(tjoin.in_window(tjoin.interval_join(left, right, ("o_custkey", "k"), "left"), T1, T2), "sys_to")


@query(f"{PAIRS} SELECT o_custkey, o_orderkey, f AS sys_from, CASE WHEN t < 9223372036854775807 THEN t END AS sys_to FROM cov WHERE {KEEP}")
def interval_join_semi(spark, sf_dir):
    left, right = _sides(spark, sf_dir)
    return timeline.shown(tjoin.in_window(tjoin.interval_join(left, right, ("o_custkey", "k"), "semi"), T1, T2), "sys_to")


@query(f"{PAIRS} SELECT o_custkey, o_orderkey, f AS sys_from, CASE WHEN t < 9223372036854775807 THEN t END AS sys_to FROM gaps WHERE {KEEP}")
def interval_join_anti(spark, sf_dir):
    left, right = _sides(spark, sf_dir)
    return timeline.shown(tjoin.in_window(tjoin.interval_join(left, right, ("o_custkey", "k"), "anti"), T1, T2), "sys_to")


@query(ORACLE["interval_join_left"])
def interval_join_sliced(spark, sf_dir):
    """The LEFT join again, with a slice of time beside the key: what keys with many rows on both sides need."""
    left, right = _sides(spark, sf_dir)
    return timeline.shown(tjoin.in_window(tjoin.interval_join(left, right, ("o_custkey", "k"), "left", slices=16), T1, T2), "sys_to")


@query(
    """SELECT n_nationkey, sha256(unhex('53544c484b31' || '00000003' || '02' || printf('%016x', 4) || printf('%08x', n_nationkey)
 || '04' || printf('%016x', octet_length(encode(n_name))) || hex(encode(n_name)) || '00' || printf('%016x', 0))) AS k FROM nation"""
)
def portable_hash_key(spark, sf_dir):
    n = _t(spark, sf_dir, "nation")
    return n.select("n_nationkey", hash_key(("int4", F.col("n_nationkey")), ("text", F.col("n_name")), ("null", None)).alias("k"))


FRONT = f"""SELECT o.o_orderstatus, COUNT(*) AS n, MAX(e.value) AS top FROM o JOIN e ON o.o_custkey = e.user_id
FOR SYSTEM_TIME AS OF {E1} GROUP BY o.o_orderstatus HAVING COUNT(*) > 0"""


@query(
    f"""WITH {O}, {E} SELECT oh.o_orderstatus, COUNT(*) AS n, MAX(eh.value) AS top FROM oh JOIN eh ON o_custkey = user_id
WHERE oh.sys_from <= {E1} AND oh.sys_to > {E1} AND eh.sys_from <= {E1} AND eh.sys_to > {E1} GROUP BY oh.o_orderstatus"""
)
def temporal_sql(spark, sf_dir):
    from .plans.sql import Session

    session = Session(spark)
    session.register("o", derive.orders_history(spark, sf_dir))
    session.register("e", derive.events_history(spark, sf_dir))
    return session.sql(FRONT)


# --- the SQL front end ---


def _session(spark, **tables):
    from .plans.sql import Session

    session = Session(spark)
    for name, table in tables.items():
        session.register(name, table)
    return session


@query("SELECT n_name, COUNT(*) AS n FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE c_custkey % 2 = 0 GROUP BY n_name")
def sql_cte_shadowing(spark, sf_dir):
    s = _session(spark, o=derive.orders_history(spark, sf_dir), c=_t(spark, sf_dir, "customer"), n=_t(spark, sf_dir, "nation"))
    return s.sql("WITH o AS (SELECT c_nationkey AS k FROM c WHERE c_custkey % 2 = 0), c(n_name, k) AS (SELECT n_name, n_nationkey FROM n) SELECT c.n_name, COUNT(*) AS n FROM o JOIN c ON o.k = c.k GROUP BY c.n_name")


@query(
    """SELECT l_orderkey, l_linenumber, CASE WHEN d <> 0 THEN q // d END AS over, CASE WHEN d <> 0 THEN q % d END AS rest, TRY(q * 100000000) AS times,
TRY(w * q) AS wide, (-q) // 2 AS half, 1e1 AS ten FROM (SELECT l_orderkey, l_linenumber, CAST(l_quantity AS INT) AS q, CAST(l_linenumber % 3 AS INT) AS d, CAST(l_quantity AS BIGINT) * 184467440737095516 AS w FROM lineitem)"""
)
def sql_integer_arithmetic(spark, sf_dir):
    li = _t(spark, sf_dir, "lineitem").selectExpr("l_orderkey", "l_linenumber", "CAST(l_quantity AS INT) AS q", "l_linenumber % 3 AS d", "CAST(l_quantity AS BIGINT) * 184467440737095516 AS w")
    return _session(spark, li=li).sql("SELECT l_orderkey, l_linenumber, q / d AS over, q % d AS rest, q * 100000000 AS times, w * q AS wide, -q / 2 AS half, 1e1 AS ten FROM li")


@query(
    """SELECT l_suppkey, CASE WHEN s BETWEEN -9223372036854775808 AND 9223372036854775807 THEN CAST(s AS BIGINT) END AS s, n FROM (
SELECT l_suppkey, SUM(CAST(w AS HUGEINT)) AS s, COUNT(*) AS n FROM (SELECT l_suppkey, CAST(l_quantity AS BIGINT) * 46116860184273879 AS w FROM lineitem WHERE l_linenumber = 1) GROUP BY l_suppkey)
ORDER BY s DESC NULLS FIRST, n DESC, l_suppkey LIMIT 25"""
)
def sql_sum_and_null_order(spark, sf_dir):
    li = _t(spark, sf_dir, "lineitem").where("l_linenumber = 1").selectExpr("l_suppkey", "CAST(l_quantity AS BIGINT) * 46116860184273879 AS w")
    return _session(spark, li=li).sql("SELECT l_suppkey, SUM(w) AS s, COUNT(*) AS n FROM li GROUP BY l_suppkey ORDER BY s DESC, n DESC, l_suppkey LIMIT 25")


@query(
    f"""WITH {O} SELECT o_custkey, o_orderkey, c_nationkey, sys_from, {SHOW.format('sys_to')} FROM oh JOIN customer ON o_custkey = c_custkey
WHERE c_nationkey < 5 AND sys_to > {T1} AND sys_from < {T2}"""
)
def sql_range_join_with_cte(spark, sf_dir):
    s = _session(spark, o=derive.orders_history(spark, sf_dir), c=_t(spark, sf_dir, "customer"))
    return s.sql(f"WITH own AS (SELECT c_custkey AS ck, c_nationkey FROM c WHERE c_nationkey < 5) SELECT o_custkey, o_orderkey, c_nationkey, sys_from, sys_to FROM o JOIN own ON o_custkey = ck FOR SYSTEM_TIME FROM {T1} TO {T2}")


@query(
    f"""WITH {P}, a AS (SELECT * FROM ph WHERE {LIVE.format(T2)}) SELECT a.l_partkey, a.qty, b.qty AS next_qty FROM a JOIN a AS b ON a.l_partkey = b.l_partkey + 1
WHERE a.valid_from < a.valid_to AND b.valid_from < b.valid_to AND a.valid_from < b.valid_to AND b.valid_from < a.valid_to"""
)
def sql_period_over_join(spark, sf_dir):
    h = derive.parts_history(spark, sf_dir)
    moved = timeline.History(h.versions.withColumn("l_partkey", F.col("l_partkey") + 1).withColumnRenamed("qty", "next_qty"), "l_partkey", ("l_partkey", "l_suppkey", "next_qty"), None, True)
    return _session(spark, p=h, q=moved).sql(f"SELECT p.l_partkey, qty, next_qty FROM p JOIN q ON p.l_partkey = q.l_partkey FOR SYSTEM_TIME AS OF {T2} WHERE PERIOD(p.valid_from, p.valid_to) OVERLAPS PERIOD(q.valid_from, q.valid_to)")


COMPARED = """SELECT s_suppkey, (SELECT COUNT(*) FROM nation WHERE n_nationkey < s_nationkey) AS below FROM supplier AS x
WHERE s_nationkey >= (SELECT MIN(n_nationkey) + 3 FROM nation WHERE n_regionkey = 2)
  AND EXISTS (SELECT 1 FROM customer WHERE c_nationkey > x.s_nationkey) AND s_suppkey <> (SELECT MAX(s_suppkey) FROM supplier)"""


@query(COMPARED)
def sql_scalar_and_correlated(spark, sf_dir):
    return _session(spark, **{t: _t(spark, sf_dir, t) for t in ("supplier", "nation", "customer")}).sql(COMPARED)


# --- the store: each script makes a store of its own, whose clock stands still, so commits fall on 1000, 1001, ... ---


def _store_session(spark, sf_dir):
    from .plans.statements import StoreSession
    from .sources.store import Store

    session = StoreSession(Store(spark, f"{shared_folder(spark)}/tempora-store/{uuid.uuid4().hex}", principal="bench", clock=lambda: 1000))
    session.register("c", _t(spark, sf_dir, "customer").select("c_custkey", derive.cents("c_acctbal").alias("cents")))
    return session


def _run(session, *statements: str) -> DataFrame:
    for text in statements[:-1]:
        session.sql(text)
    return session.sql(statements[-1])


MAKE = "CREATE TABLE t (id BIGINT, balance BIGINT) WITH SYSTEM VERSIONING"
FILL = "INSERT INTO t SELECT c_custkey, cents FROM c"
WRITES = (MAKE, FILL, "UPDATE t SET balance = balance + 1 WHERE id % 3 = 0", "DELETE FROM t WHERE id % 5 = 0")
C = "c AS (SELECT c_custkey AS id, CAST(ROUND(c_acctbal * 100) AS BIGINT) AS b FROM customer)"
VERSIONS = f"""{C}, v AS (
SELECT id, 'INSERT' AS op, 1001::BIGINT AS sys_from, CASE WHEN id % 3 = 0 THEN 1002 WHEN id % 5 = 0 THEN 1003 END::BIGINT AS sys_to, b AS balance, 2::BIGINT AS txn FROM c
UNION ALL SELECT id, 'UPDATE', 1002, CASE WHEN id % 5 = 0 THEN 1003 END, b + 1, 3 FROM c WHERE id % 3 = 0)"""


@query(f"WITH {C} SELECT id, CASE WHEN id % 3 = 0 THEN b + 1 ELSE b END AS balance FROM c WHERE id % 5 <> 0")
def store_writes(spark, sf_dir):
    return _run(_store_session(spark, sf_dir), *WRITES, "SELECT * FROM t")


@query(f"WITH {VERSIONS} SELECT id, balance FROM v WHERE sys_from <= 1002 AND COALESCE(sys_to, 9999) > 1002")
def store_as_of_compacted(spark, sf_dir):
    return _run(_store_session(spark, sf_dir), *WRITES, "COMPACT", "SELECT * FROM t FOR SYSTEM_TIME AS OF 1002")


@query(f"WITH {VERSIONS} SELECT id, balance, sys_from, sys_to FROM v WHERE sys_from < 1003 AND COALESCE(sys_to, 9999) > 1002")
def store_range_compacted(spark, sf_dir):
    return _run(_store_session(spark, sf_dir), *WRITES, "COMPACT", "UPDATE t SET balance = 0 WHERE id = 1", "SELECT * FROM t FOR SYSTEM_TIME FROM 1002 TO 1003").withColumn("sys_to", F.when(F.col("sys_to") <= 1003, F.col("sys_to")))


@query(f"WITH {VERSIONS} SELECT id, op, sys_from, sys_to, sys_to IS NULL AS current, balance, txn AS txn_id, sys_from AS committed_at, 'bench' AS principal FROM v")
def store_history(spark, sf_dir):
    rows = _run(_store_session(spark, sf_dir), *WRITES, "SELECT * FROM t_history('t')")
    return rows.withColumnsRenamed({f"_prov_{c}": c for c in ("txn_id", "committed_at", "principal")})


@query(f"WITH {VERSIONS} SELECT id, sys_from, txn, true AS linked FROM v")
def store_audit(spark, sf_dir):
    return _run(_store_session(spark, sf_dir), *WRITES, "SELECT id, sys_from, _prov_txn_id AS txn, linked FROM t_audit('t')")


@query(f"WITH {VERSIONS} SELECT id, balance, txn, sys_from AS at FROM v WHERE sys_to IS NULL AND txn = 3")
def store_provenance(spark, sf_dir):
    return _run(_store_session(spark, sf_dir), *WRITES, "SELECT t.*, _prov_txn_id AS txn, _prov_committed_at AS at FROM t WHERE _prov_txn_id = 3")


@query(f"WITH {VERSIONS} SELECT CASE WHEN sys_to IS NULL THEN 'open' ELSE 'sealed' END AS state, 'id' AS key_column, COUNT(*)::BIGINT AS n, MIN(sys_from) AS sys_min, MAX(sys_from) AS sys_max FROM v GROUP BY 1")
def store_segments(spark, sf_dir):
    return _run(_store_session(spark, sf_dir), *WRITES, "COMPACT", "SELECT state, key_column, SUM(rows) AS n, MIN(sys_min) AS sys_min, MAX(sys_max) AS sys_max FROM t_segments('t') GROUP BY state, key_column")


@query(f"WITH {C} SELECT id, CASE WHEN id % 2 = 0 AND id // 2 IN (SELECT id FROM c) THEN 7 ELSE b END AS b FROM c UNION ALL SELECT 2 * id, 7 FROM c WHERE 2 * id NOT IN (SELECT id FROM c)")
def store_merge_valid_time(spark, sf_dir):
    s = _store_session(spark, sf_dir)
    s.register("feed", s.tables["c"].selectExpr("c_custkey * 2 AS k", "7L AS nb", "50L AS f", "60L AS t"))
    return _run(
        s,
        "CREATE TABLE v (id BIGINT, b BIGINT, vf BIGINT, vt BIGINT) WITH SYSTEM VERSIONING VALID TIME (vf, vt)",
        "INSERT INTO v SELECT c_custkey, cents, 0L, 100L FROM c",
        "MERGE INTO v USING feed ON v.id = feed.k WHEN MATCHED THEN UPDATE SET b = feed.nb, vf = feed.f, vt = feed.t WHEN NOT MATCHED THEN INSERT (id, b, vf, vt) VALUES (feed.k, feed.nb, feed.f, feed.t)",
        "SELECT id, b FROM v FOR VALID_TIME AS OF 55",
    )


@query(f"WITH {C} SELECT 'inside' AS place, id, b AS balance FROM c WHERE id % 2 = 1 UNION ALL SELECT 'before', -1, 0 UNION ALL SELECT 'after', id, b FROM c")
def store_transaction(spark, sf_dir):
    """Reads inside see the transaction's own writes; what a savepoint takes back is not committed."""
    s = _store_session(spark, sf_dir)
    s.sql(MAKE)
    s.sql("INSERT INTO t VALUES (-1, 0)")
    before = s.store.now()
    _run(s, "BEGIN", "DELETE FROM t", FILL, "SAVEPOINT one")
    inside = _run(s, "DELETE FROM t WHERE id % 2 = 0", "SELECT 'inside' AS place, id, balance FROM t")
    _run(s, "ROLLBACK TO SAVEPOINT one", "COMMIT")
    return inside.unionByName(s.sql(f"SELECT 'before' AS place, id, balance FROM t FOR SYSTEM_TIME AS OF {before}")).unionByName(s.sql("SELECT 'after' AS place, id, balance FROM t"))


@query("SELECT n_nationkey AS id, n_name AS name, NULL::BIGINT AS region FROM nation")
def store_copy_backup_restore(spark, sf_dir):
    from .plans.statements import StoreSession
    from .sources.store import Store

    s = _store_session(spark, sf_dir)
    _t(spark, sf_dir, "nation").select("n_name", "n_nationkey").write.csv(f"{s.store.root}-in", header=True)
    _run(
        s,
        "CREATE TABLE n (id INT, name TEXT, region BIGINT) WITH SYSTEM VERSIONING",
        f"COPY n (name, id) FROM '{s.store.root}-in' WITH (FORMAT csv, HEADER)",
        "CREATE INDEX by_name ON n (name)",
        f"BACKUP TO '{s.store.root}-copy'",
    )
    return StoreSession(Store.restore(spark, f"{s.store.root}-copy", f"{s.store.root}-again", clock=lambda: 1000)).sql("SELECT * FROM n")


@query("SELECT 'n' AS table_name, 1::BIGINT AS txn, 1000::BIGINT AS at, true AS linked UNION ALL SELECT 'dropped', 2, 1001, true UNION ALL SELECT NULL, 3, 1002, true")
def store_catalog_and_chain(spark, sf_dir):
    """One row a commit: the chain holds, and the catalogue as of it names the table it made."""
    s = _store_session(spark, sf_dir)
    _run(s, "CREATE TABLE n (id INT) WITH SYSTEM VERSIONING", "CREATE TABLE dropped (id INT) WITH SYSTEM VERSIONING", "DROP TABLE dropped")
    made = spark.createDataFrame([(m["seq"], d["name"] if d["op"] == "create" else None) for m in s.store.manifests() for d in m["ddl"]], "seq bigint, table_name string")
    return s.store.commits().join(made, "seq").select("table_name", "txn", "at", "linked")
