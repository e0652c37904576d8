"""Every registered query against its SQL twin on the smallest tables."""

import math

import duckdb
import pytest

import __spark_entry__ as driver

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()
QUERIES = driver.queries()
SQL = driver.oracle_sql()


@pytest.fixture(scope="module")
def duck(sf):
    connection = duckdb.connect()
    for name in TABLES:
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf}/{name}.parquet'")
    return connection


def _rows(table):
    columns = sorted(table.column_names)
    return sorted(zip(*[table.column(c).to_pylist() for c in columns]), key=repr)


def _equal(left, right):
    if isinstance(left, float) and isinstance(right, float):
        return math.isclose(left, right, rel_tol=1e-9, abs_tol=2e-6)
    return left == right


@pytest.mark.parametrize("name", sorted(SQL))
def test_matches_sql(name, spark, sf, duck):
    ours = QUERIES[name](spark, sf).toArrow()
    theirs = duck.execute(SQL[name]).to_arrow_table()
    assert sorted(ours.column_names) == sorted(theirs.column_names)
    a, b = _rows(ours), _rows(theirs)
    assert len(a) == len(b)
    for x, y in zip(a, b):
        assert all(_equal(p, q) for p, q in zip(x, y)), (x, y)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_runs(name, spark, sf):
    assert QUERIES[name](spark, sf).count() > 0


def test_sql_only_for_queries():
    assert set(SQL) <= set(QUERIES)


def test_entry(spark):
    assert driver.entry(spark).count() > 0
