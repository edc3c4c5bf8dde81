"""Every registered query against its SQL twin on the smallest tables."""

import os

import duckdb
import pytest

import __spark_entry__ as contract
from check import TABLES, rows_of

SF_DIR = os.environ.get("OPSLOG_SF_DIR", "/root/testdata/sf0.001")
QUERIES, SQL = contract.queries(), contract.oracle_sql()
pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SF_DIR}/{name}.parquet'")
    return con


def test_every_sql_has_a_query():
    assert SQL.keys() <= QUERIES.keys()


@pytest.mark.parametrize("name", sorted(SQL))
def test_rows_match(spark, duck, name):
    df = QUERIES[name](spark, SF_DIR)
    mine = rows_of(df.columns, [tuple(r) for r in df.collect()])
    cursor = duck.execute(SQL[name])
    assert mine == rows_of([c[0] for c in cursor.description], cursor.fetchall())


@pytest.mark.parametrize("name", sorted(QUERIES.keys() - SQL.keys() - {"grid_search", "stream_incidents"}))
def test_rows_come_back(spark, name):
    assert QUERIES[name](spark, SF_DIR).count() > 0


def test_entry(spark):
    assert contract.entry(spark).columns == ["timestamp", "normal_logs", "anomalies"]
