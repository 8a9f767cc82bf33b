"""Every registered query against its SQL on DuckDB, on the smallest tables."""

import os
import sys

import duckdb
import pytest

sys.path.insert(0, os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "tools"))

import __spark_entry__ as entry  # noqa: E402
from check import TABLES, table_of  # noqa: E402

QUERIES = entry.queries()
SQL = entry.oracle_sql()


@pytest.fixture(scope="module")
def db(sf):
    connection = duckdb.connect()
    connection.execute("SET TimeZone='UTC'")
    for name in TABLES:
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{sf}/{name}.parquet')")
    return connection


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, db, sf, name):
    df = QUERIES[name](spark, sf)
    got = table_of(df.columns, [tuple(r) for r in df.collect()])
    cursor = db.execute(SQL[name])
    want = table_of([d[0] for d in cursor.description], cursor.fetchall())
    assert got == want


def test_every_sql_has_a_query():
    assert set(SQL) <= set(QUERIES)


def test_flagship_query(spark):
    assert entry.entry(spark).columns == ["doc_id", "errors", "warnings", "codes", "status"]
