"""Every registered query against its SQL twin on the smallest tables."""

import math

import duckdb
import pytest

import __spark_entry__ as driver
from quillprint.plans.registry import load

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
          "conversations").split()


@pytest.fixture(scope="module")
def tables(small):
    con = duckdb.connect()
    for table in TABLES:
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{small}/{table}.parquet'")
    return con


def _normal(value):
    return "nan" if isinstance(value, float) and math.isnan(value) else repr(value)


def _sorted(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(_normal(r[i]) for i in order) for r in rows)


@pytest.mark.parametrize("name", sorted(load()))
def test_query(spark, small, tables, name):
    run, sql = load()[name]
    df = run(spark, small)
    got = _sorted(df.columns, [tuple(r) for r in df.collect()])
    assert got or name.startswith("c4")
    if sql:
        cursor = tables.execute(sql)
        columns = [d[0] for d in cursor.description]
        assert sorted(columns) == sorted(df.columns)
        assert got == _sorted(columns, cursor.fetchall())


def test_entry(spark):
    assert driver.entry(spark).columns == ["model_name", "pos", "value"]
    assert set(driver.oracle_sql()) <= set(driver.queries())
