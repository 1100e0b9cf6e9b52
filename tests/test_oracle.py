"""Every query that has SQL against DuckDB over the smallest tables."""

import os

import duckdb
import pandas as pd
import pytest

from tempora import queries

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events".split()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def same(df):
    def cell(x):
        return "null" if pd.isna(x) else str(x) if isinstance(x, (str, bool)) else f"{float(x):.6f}"

    return sorted([cell(x) for x in r] for r in df[sorted(df.columns)].itertuples(index=False))


@pytest.mark.skipif(not os.path.isdir(SF), reason="test tables are not here")
@pytest.mark.parametrize("name", sorted(queries.ORACLE))
def test_query(spark, duck, name):
    got, expected = queries.QUERIES[name](spark, SF).toPandas(), duck.execute(queries.ORACLE[name]).df()
    assert sorted(got.columns) == sorted(expected.columns) and same(got) == same(expected)
