"""Every query against its SQL in DuckDB, over the smallest tables."""

import os

import duckdb
import pytest

from signalmill.plans import queries as plans

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def oracle():
    con = duckdb.connect()
    con.sql("SET timezone = 'UTC'")
    for f in os.listdir(FOLDER):
        con.sql(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{FOLDER}/{f}'")
    return con


def ordered(rows):
    return sorted(map(tuple, rows), key=lambda r: tuple((x is not None, str(x)) for x in r))


@pytest.mark.parametrize("name", sorted(plans.QUERIES))
def test_query(spark, oracle, name):
    df = plans.QUERIES[name](spark, FOLDER)
    columns = sorted(df.columns)
    rows = ordered(df.select(*columns).collect())
    if name not in plans.SQL:
        assert rows
        return
    expected = oracle.sql(f"SELECT {', '.join(columns)} FROM ({plans.SQL[name]})")
    assert sorted(oracle.sql(plans.SQL[name]).columns) == columns
    assert rows == ordered(expected.fetchall())
