"""Temporal operators against hand-checked cases, brute force and the format's vectors."""

import random

import pytest
from pyspark.sql import functions as F

from tempora.functions import numeric
from tempora.functions.hashkey import hash_key
from tempora.operators import periods, shape, timeline, tjoin
from tempora.operators.timeline import FOREVER, History, TemporalError
from tempora.plans.sql import Session


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def make(spark, versions, gone=(), valid=False):
    more = ", valid_from bigint, valid_to bigint" if valid else ""
    v = spark.createDataFrame(versions, f"k int, sys_from bigint, seq bigint, a int{more}")
    g = spark.createDataFrame(list(gone), "k int, sys_from bigint, seq bigint, closed_at bigint")
    return History(v, "k", ("k", "a"), g, valid)


def test_same_tick_and_boundaries(spark):
    h = make(spark, [(1, 10, 1, 1), (1, 10, 2, 2), (1, 20, 3, 3)], [(1, 20, 3, 30)])
    assert rows(timeline.as_of(h, 9)) == [] and rows(timeline.as_of(h, 10)) == [(1, 2)]
    assert rows(timeline.as_of(h, 19)) == [(1, 2)] and rows(timeline.as_of(h, 20)) == [(1, 3)]
    assert rows(timeline.as_of(h, 29)) == [(1, 3)] and rows(timeline.as_of(h, 30)) == []
    assert rows(timeline.system_range(h, 0, 100)) == [(1, 2, 10, 20), (1, 3, 20, 30)]
    assert rows(timeline.system_range(h, 5, 10)) == [] and len(rows(timeline.system_range(h, 5, 10, closed=True))) == 1
    for a, b, closed in ((5, 5, False), (6, 5, True)):
        with pytest.raises(TemporalError):
            timeline.system_range(h, a, b, closed)


def test_sliced_endpoints_and_pushdown(spark, tmp_path):
    rnd = random.Random(3)
    data = [(rnd.randrange(3), rnd.randrange(200), i, i) for i in range(300)]
    h = make(spark, data)
    for width in (1, 7, 50, 1000):
        assert rows(timeline.endpoints(h, slice_us=width)) == rows(timeline.endpoints(h))
    h.versions.write.parquet(str(tmp_path / "log"))
    stored = h.with_logs(spark.read.parquet(str(tmp_path / "log")), None)
    plan = timeline.as_of(stored, 50, columns=["k"])._jdf.queryExecution().toString()
    assert "LessThanOrEqual(sys_from,50)" in plan and "a:int" not in plan.split("ReadSchema")[1]


def brute(left, right, how):
    out = []
    for lk, lv, lf, lt in left:
        marks = sorted({lf, lt, *[x for rk, _, rf, rt in right if rk == lk for x in (rf, rt) if lf < x < lt]})
        hits = [(rv, max(lf, rf), min(lt, rt)) for rk, rv, rf, rt in right if rk == lk and max(lf, rf) < min(lt, rt)]
        if how in ("inner", "left"):
            out += [(lk, lv, lk, rv, f, t) for rv, f, t in hits]
        covered, gaps = [], []
        for a, b in zip(marks, marks[1:], strict=False):
            into = covered if any(f <= a and b <= t for _, f, t in hits) else gaps
            if into and into[-1][1] == a:
                into[-1] = (into[-1][0], b)
            else:
                into.append((a, b))
        if how == "left":
            out += [(lk, lv, None, None, f, t) for f, t in gaps]
        if how in ("semi", "anti"):
            out += [(lk, lv, f, t) for f, t in (covered if how == "semi" else gaps)]
    return sorted(out, key=str)


@pytest.mark.parametrize("how", ["inner", "left", "semi", "anti"])
def test_interval_joins(spark, how):
    rnd = random.Random(5)

    def some(n):
        out = []
        for i in range(n):
            f = rnd.randrange(12)
            out.append((rnd.randrange(4), i, f, rnd.choice([FOREVER, f + 1 + rnd.randrange(6)])))
        return out

    left, right = some(40), some(40)
    a = spark.createDataFrame(left, "lk int, lv int, sys_from bigint, sys_to bigint")
    b = spark.createDataFrame(right, "rk int, rv int, sys_from bigint, sys_to bigint")
    for slices in (None, 2, 5, 40):
        assert rows(tjoin.interval_join(a, b, ("lk", "rk"), how, slices=slices)) == brute(left, right, how), slices
    none = b.where("rk < 0")
    assert rows(tjoin.interval_join(a, none, ("lk", "rk"), how, slices=4)) == brute(left, [], how)
    assert tjoin.interval_join(a.where("lk < 0"), none, ("lk", "rk"), how, slices=4).count() == 0


def test_slices_of_time_keep_a_hot_key_apart(spark):
    """One key on both sides, short periods one after another: the pairs tried are near the pairs found."""
    a = spark.range(400).selectExpr("1 lk", "id lv", "id * 10 sys_from", "id * 10 + 10 sys_to")
    b = spark.range(400).selectExpr("1 rk", "id rv", "id * 10 + 5 sys_from", "id * 10 + 15 sys_to")
    assert tjoin.interval_join(a, b, ("lk", "rk"), "inner", slices=40).count() == 799
    cuts = tjoin.quantiles(a, b, "sys_from", 40)
    left, right = tjoin.dealt(a, cuts, "sys_from", "sys_to", "_l"), tjoin.dealt(b, cuts, "sys_from", "sys_to", "_r")
    tried = left.join(right, (left.lk == right.rk) & (left._lslice == right._rslice)).count()
    assert left.count() <= 440 and tried < 400 * 400 / 20


def test_fragmentation_through_sql(spark):
    l, r = make(spark, [(1, 10, 1, 7)]), make(spark, [(1, 20, 1, 8)], [(1, 20, 1, 30)])
    s = Session(spark, lambda: 1000)
    s.register("l", l)
    s.register("r", r)
    q = "SELECT {} FROM l {} JOIN r ON l.k = r.k FOR SYSTEM_TIME FROM 0 TO 100"
    assert rows(s.sql(q.format("l.a, r.a AS b, sys_from, sys_to", "LEFT"))) == sorted([(7, 8, 20, 30), (7, None, 10, 20), (7, None, 30, None)], key=str)
    assert rows(s.sql(q.format("l.a, sys_from, sys_to", "ANTI"))) == sorted([(7, 10, 20), (7, 30, None)], key=str)
    assert rows(s.sql(q.format("l.a, sys_from, sys_to", "SEMI"))) == [(7, 20, 30)]
    assert rows(s.sql(q.format("*", "INNER"))) == [(1, 7, 1, 8, 20, 30)]
    s.register("c", spark.createDataFrame([(1, 5)], "k int, w int"))
    assert rows(s.sql("SELECT l.a, c.w, sys_from FROM l JOIN c ON l.k = c.k FOR SYSTEM_TIME FROM 0 TO 100")) == [(7, 5, 10)]
    assert s.explain("SELECT * FROM l FOR SYSTEM_TIME AS OF 15").count() > 4


def test_sql_rules(spark):
    s = Session(spark, lambda: 1000)
    s.register("t", make(spark, [(1, 10, 1, 7), (2, 10, 2, 8)]))
    s.register("v", make(spark, [(1, 10, 1, 7, 100, 200), (2, 10, 2, 8, 150, FOREVER)], valid=True))
    assert rows(s.sql("SELECT k FROM v FOR SYSTEM_TIME AS OF now() FOR VALID_TIME AS OF 120")) == [(1,)]
    assert rows(s.sql("SELECT k, valid_to FROM v FOR VALID_TIME BETWEEN 200 AND 300")) == [(2, None)]
    assert rows(s.sql("SELECT k FROM t FOR SYSTEM_TIME AS OF (now() - interval '1 millisecond')")) == []
    assert rows(s.sql("SELECT k, a FROM v WHERE PERIOD(valid_from, valid_to) CONTAINS PERIOD(160, 190)")) == [(1, 7), (2, 8)]
    assert rows(s.sql("SELECT k FROM t WHERE PERIOD(10, 20) OVERLAPS PERIOD(20, 30)")) == []
    assert len(rows(s.sql("SELECT k FROM t WHERE PERIOD(10, 20) PRECEDES PERIOD(20, 30)"))) == 2
    assert rows(s.sql("SELECT t.k, v.a FROM t JOIN v ON t.k = v.k FOR SYSTEM_TIME AS OF 10 WHERE v.a > 7")) == [(2, 8)]
    assert rows(s.sql("WITH x AS (SELECT k FROM t WHERE a = 7) SELECT k FROM v WHERE k IN (SELECT k FROM x)")) == [(1,)]
    for bad in (
        "SELECT k FROM t FOR SYSTEM_TIME AS OF 1 FOR SYSTEM_TIME AS OF 2",
        "SELECT k FROM t FOR VALID_TIME AS OF 1",
        "SELECT k FROM t FOR SYSTEM_TIME FROM 5 TO 5",
        "SELECT k FROM t FOR SYSTEM_TIME FROM 1 TO 5 FOR SYSTEM_TIME AS OF 2",
        "SELECT k FROM t FOR SYSTEM_TIME AS OF now() - interval '1 month'",
        "SELECT k FROM t WHERE PERIOD(20, 10) OVERLAPS PERIOD(1, 2)",
        "SELECT k FROM t WHERE PERIOD(1, 2) OVERLAPS PERIOD(1, 2) AND k = 1",
    ):
        with pytest.raises(TemporalError):
            s.sql(bad)


def test_period_truth_table(spark):
    span = spark.createDataFrame([(a, b, c, d) for a in range(4) for b in range(5) for c in range(4) for d in range(5) if c < d], "a int, b int, c int, d int")
    expected = {
        "CONTAINS": lambda a, b, c, d: a <= c and d <= b,
        "OVERLAPS": lambda a, b, c, d: bool(set(range(a, b)) & set(range(c, d))),
        "EQUALS": lambda a, b, c, d: (a, b) == (c, d),
        "PRECEDES": lambda a, b, c, d: b <= c,
        "SUCCEEDS": lambda a, b, c, d: d <= a,
        "MEETS": lambda a, b, c, d: b == c,
        "IMMEDIATELY SUCCEEDS": lambda a, b, c, d: a == d,
    }
    for name, truth in expected.items():
        got = span.select("a", "b", "c", "d", periods.compare(("a", "b"), name, ("c", "d")).alias("x")).collect()
        assert all(r.x == (truth(r.a, r.b, r.c, r.d) if r.a < r.b else None) for r in got), name


# Published digests of the portable hash key, version 1, under its own magic.
MAGIC = b"STLHK1"
VECTORS = [
    ([], "c3ae0194dddca9863f78e86574fa26d75441dd94643ea5ef3196058761db054f"),
    ([("null", None)], "11e5cc31f5ab758bacb047a87c2e7400b17e99508b39efa45bd05fb3486fcca0"),
    ([("text", F.lit)], "cd43236bcc33b39a3530894687eb75fd004687e3aebf79e9739864a576b80578", ""),
    ([("text", F.lit)], "809cf7dd76e429f04505df3c8df09e59e8c081fdd404bfe1d6e330aee4c2f82e", "acme"),
    ([("int4", F.lit)], "96d0d0ba3e2c2426333516658650326edc8ac00fb3225299a1b24e21c56cf0c9", 42),
    ([("int8", F.lit)], "29a3cc3ace5b15675d46dc9e13804f0ab65feaf17dc14090b3d9ccdfba6c7061", 42),
    ([("bool", F.lit)], "4c7d2e3d4dd051d20ab6da771cf4b167e4014b08d8b2d5b4e6b92da26b890ba9", True),
    ([("timestamptz", F.lit)], "8720f97303210b1ae946845bfaad4a52d062189d52e098b5b4b3278708b2db31", 1_700_000_000_000_000),
    ([("uuid", F.lit)], "8c149c5fb901c43282f7b67163b24a1f1de2bb3c72df46707a37b4bc4f0ae811", "550e8400-e29b-41d4-a716-446655440000"),
    ([("bytea", F.lit)], "81ed9d4be87550352ed909232a1b669bde775b2ae106ae2d892dc475bd043fc5", b"\xde\xad\xbe\xef"),
    ([("bytea", F.lit)], "79649e69f651affd02e15ab04eaae96fb60f72387989148d4fee9769cc1fa278", b""),
]


def test_hash_vectors(spark):
    one = spark.range(1)
    for args, digest, *value in VECTORS:
        made = [(k, f(value[0]) if f else None) for k, f in args]
        assert one.select(hash_key(*made, magic=MAGIC)).first()[0] == digest
    span = F.struct(F.lit(10).cast("long").alias("from"), F.lit(20).cast("long").alias("to"))
    assert one.select(hash_key(("period", span), magic=MAGIC)).first()[0] == "35ccfb9906f082824c65f8e0ef866f4439cb8e4217a9ff5d3890d95fdff0379c"
    three = hash_key(("text", F.lit("acme")), ("int4", F.lit(42)), ("text", F.lit(None).cast("string")), magic=MAGIC)
    assert one.select(three).first()[0] == "61c9586983296ab2e403396f6ce20b01e2adc2514633fc63bb9d5a1e0ce85a20"


def test_arithmetic_and_shape(spark):
    d = spark.createDataFrame([((1 << 31) - 1, 1), (7, 0), (-7, 2), (-(1 << 31), -1), (None, 3)], "a int, b int")
    a, b = F.col("a"), F.col("b")
    got = d.select(numeric.add(a, b), numeric.divide(a, b, "int"), numeric.modulo(a, b)).collect()
    assert [tuple(r) for r in got] == [(None, (1 << 31) - 1, 0), (7, None, None), (-5, -3, -1), (None, None, 0), (None, None, None)]
    assert d.select(numeric.divide(a, b, "int").alias("x")).dtypes == [("x", "int")]
    assert [r.a for r in shape.order_by(d, "a").collect()][-1] is None and [r.a for r in shape.order_by(d, "a DESC").collect()][0] is None
    big = spark.createDataFrame([((1 << 63) - 1,), (1,)], "a bigint")
    assert shape.aggregate(big, [], {"s": ("sum", "a"), "n": ("count", "*")}).first() == (None, 2)
    assert shape.limit(d, 0).count() == 0 and shape.limit(d, None, 99).count() == 0
    assert shape.aggregate(d.limit(0), [], {"n": ("count", "*")}).first().n == 0 and shape.aggregate(d.limit(0), ["b"], {"n": ("count", "*")}).count() == 0
