"""Queries against DuckDB on the smallest tables."""

import os

import pytest

import __spark_entry__ as driver
from gazetrail.plans import queries

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="the driver's tables are not here")


@pytest.fixture(scope="module")
def duck():
    import duckdb

    con = duckdb.connect()
    for t in ("nation", "customer", "orders", "lineitem", "events", "documents", "labels", "embeddings", "conversations"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(repr(tuple(float(r[i]) if isinstance(r[i], float) else r[i] for i in order)) for r in data)


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_against_sql(spark, duck, name):
    df = queries.queries()[name](spark, SF)
    got = duck.execute(queries.oracle_sql()[name])
    columns = [c[0] for c in got.description]
    assert rows(df.columns, df.collect()) == rows(columns, got.fetchall())
    assert sorted(df.columns) == sorted(columns)


def test_entry(spark):
    assert driver.entry(spark).count() == 4
    assert set(driver.oracle_sql()) <= set(driver.queries())
