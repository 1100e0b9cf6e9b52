"""Plans and steps that grow no faster than their input."""

import time

import pytest
from pyspark.sql import functions as F

from tempora import queries
from tempora.functions import numeric
from tempora.plans.sql import Session

SF = "/root/testdata/sf0.001"


@pytest.fixture
def large(spark):
    """Tables too large to broadcast."""
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield spark
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_subqueries_compare_no_pairs(large):
    assert "NestedLoop" not in plan(queries.subqueries_and_ctes(large, SF))


def test_a_scalar_subquery_has_one_row(large):
    s = Session(large, lambda: 1000)
    s.register("a", large.createDataFrame([(1,), (2,), (3,), (None,)], "k int"))
    s.register("b", large.createDataFrame([(1, 10, "x"), (2, None, "y"), (4, 40, "z"), (4, 41, "z"), (None, 5, "n")], "j int, v int, w string"))

    def rows(text):
        df = s.sql(text)
        assert "NestedLoop" not in plan(df)
        return df.columns, sorted((tuple(r) for r in df.collect()), key=str)

    assert rows("SELECT k, (SELECT v FROM b WHERE j = k) AS own FROM a")[1] == [(1, 10), (2, None), (3, None), (None, None)]
    assert rows("SELECT k FROM a WHERE (SELECT w FROM b WHERE j = k) >= 'x' AND k IN (SELECT j FROM b)")[1] == [(1,), (2,)]
    assert rows("SELECT k FROM a WHERE (SELECT w FROM b WHERE j = k) >= 'x'")[1] == [(1,), (2,)]  # 4 has two rows, none asks for it
    assert rows("SELECT k, COALESCE((SELECT v + 1 FROM b WHERE j = k /* one */), -k) AS own FROM a WHERE EXISTS (SELECT 1 FROM b WHERE j <> 9 AND j = k) OR k = 3")[1] == [(1, 11), (2, -2), (3, -3)]
    assert rows("SELECT k, (SELECT MAX(v) FROM b) AS most, ((SELECT DISTINCT w FROM b WHERE j = k AND v > 0)) AS own FROM a WHERE k = 1")[1] == [(1, 41, "x")]
    columns, _ = rows("SELECT k, (SELECT v FROM b WHERE j = k) FROM a")
    assert columns[1].startswith("scalarsubquery")
    with pytest.raises(Exception, match="(?i)more than one row"):
        s.sql("SELECT (SELECT v FROM b WHERE j = k + 1) AS x FROM a").collect()
    assert sorted(r.x or 0 for r in s.sql("SELECT (SELECT v FROM b WHERE j = k + 1 AND j < 4) AS x FROM a").collect()) == [0, 0, 0, 0]


SIGNS = {"+": (numeric.add, int.__add__), "-": (numeric.subtract, int.__sub__), "*": (numeric.multiply, int.__mul__)}


@pytest.mark.parametrize("width, bits", [("int", 31), ("bigint", 63)])
def test_results_at_the_edges(spark, width, bits):
    edge = 1 << bits
    root = int(edge**0.5)
    some = sorted({x for m in (-edge, -edge // 2, -root, 0, root, edge // 2, edge) for x in range(m - 2, m + 3) if -edge <= x < edge})
    t = spark.createDataFrame([(a, b) for a in some for b in [*some, None]], f"a {width}, b {width}")
    s = Session(spark, lambda: 1000)
    s.register("t", t)
    fit = lambda x: x if -edge <= x < edge else None
    for sign, (column, plain) in SIGNS.items():
        want = {(a, b): None if b is None else fit(plain(a, b)) for a in some for b in [*some, None]}
        known = s.sql(f"SELECT a, b, a {sign} b AS r FROM t")
        unknown = s.sql(f"SELECT a, b, x {sign} y AS r FROM (SELECT a, b, a AS x, b AS y FROM t) AS u")
        for df in (known, unknown, t.select("a", "b", column(F.col("a"), F.col("b")).alias("r"))):
            assert df.dtypes[2][1] == width and {(r.a, r.b): r.r for r in df.collect()} == want
    want = {(a, b): None if not b else fit(abs(a) // abs(b) * (1 if (a < 0) == (b < 0) else -1)) for a in some for b in [*some, None]}
    assert {(r.a, r.b): r.r for r in s.sql("SELECT a, b, a / b AS r FROM t").collect()} == want


def test_other_operands_stay(spark):
    s = Session(spark, lambda: 1000)
    s.register("t", spark.createDataFrame([(2, 1.5)], "a int, d double").selectExpr("*", "DATE '2020-01-30' AS day", "2.50BD AS m", "CAST(200 AS SMALLINT) AS h"))
    row = s.sql("SELECT day + a AS p, day + INTERVAL 1 DAY AS q, a * d AS r, d + d AS s, m * a AS t, h * h AS u, a + 2147483646 - 5 AS v, a + 1 + 2 + 3 + 4 + 5 + 6 + 7 + 8 + 9 AS w FROM t").first()
    assert [str(x) for x in row] == ["2020-02-01", "2020-01-31", "3.0", "3.0", "5.00", "None", "None", "47"]
    # A derived table's column of a table's name, but of another type.
    assert s.sql("SELECT a * 2 AS x FROM (SELECT d AS a FROM t) AS u").first().x == 3.0
    assert s.sql("SELECT CAST(RAND() * 10 AS INT) * 1000000000 AS x FROM t").count() == 1


def test_overflow_costs_what_a_result_costs(spark, tmp_path):
    spark.range(300_000).repartition(4).selectExpr("id", "CAST(id % 7 AS INT) AS one", "CAST(id % 7 + 1000000 AS INT) AS q", "id + 4611686018427387904 AS w").write.parquet(str(tmp_path / "t"))
    t = spark.read.parquet(str(tmp_path / "t"))
    s = Session(spark, lambda: 1000)
    s.register("t", t)

    def seconds(df):
        began = time.time()
        df.write.format("noop").mode("overwrite").save()
        return time.time() - began

    for over, fits in (
        (s.sql("SELECT q * q AS a, w * q AS b, w + w AS c, -w - w - w AS d FROM t"), s.sql("SELECT one * one AS a, id * one AS b, id + id AS c, id - id - id AS d FROM t")),
        (t.select(numeric.multiply(F.col("w"), F.col("q")), numeric.add(F.col("w"), F.col("w"))), t.select(numeric.multiply(F.col("id"), F.col("one")), numeric.add(F.col("id"), F.col("id")))),
        (s.sql("SELECT id, SUM(w * 1 + 0) AS a FROM (SELECT id, w FROM t UNION ALL SELECT id, w FROM t) AS u GROUP BY id"), s.sql("SELECT w, SUM(id * 1 + 0) AS a FROM (SELECT id, w FROM t UNION ALL SELECT id, w FROM t) AS u GROUP BY w")),
    ):
        seconds(fits)
        assert seconds(over) < 4 * seconds(fits) + 1.5
