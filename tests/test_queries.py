"""Every registered query with SQL against DuckDB on the smallest tables; the others must give rows."""

import duckdb
import pytest

import __spark_entry__ as entry
from tools.check import rows_of
from twinloom.plans.views import TABLES

FOLDER = "/root/testdata/sf0.001"
QUERIES, SQL = entry.queries(), entry.oracle_sql()


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    c.execute("set TimeZone='UTC'")
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{FOLDER}/{t}.parquet'")
    return c


def test_every_sql_has_a_query():
    assert set(SQL) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_as_sql(spark, con, name):
    df = QUERIES[name](spark, FOLDER)
    res = con.execute(SQL[name])
    cols = [c[0] for c in res.description]
    want = res.fetchall()
    assert sorted(cols) == sorted(df.columns)
    assert rows_of(df.columns, [tuple(r) for r in df.collect()]) == rows_of(cols, want)


def test_entry(spark):
    assert entry.entry(spark).count() > 0
