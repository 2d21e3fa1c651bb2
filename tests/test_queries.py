"""Every registered query with SQL against DuckDB on the smallest tables."""

import os

import duckdb
import pytest

import __spark_entry__
from treeline import queries

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in os.listdir(SF):
        c.execute(f"CREATE VIEW {t.removesuffix('.parquet')} AS SELECT * FROM '{SF}/{t}'")
    return c


def normal(rows, names):
    order = sorted(range(len(names)), key=lambda i: names[i])
    fix = lambda x: round(x, 5) if isinstance(x, float) else x
    return sorted((tuple(fix(r[i]) for i in order) for r in rows), key=repr)


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_against_sql(spark, con, name):
    df = queries.queries()[name](spark, SF)
    got = normal([tuple(r) for r in df.collect()], df.columns)
    ask = con.execute(queries.oracle_sql()[name])
    names = [d[0] for d in ask.description]
    assert sorted(names) == sorted(df.columns)
    assert got == normal(ask.fetchall(), names)


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
