"""Queries against their SQL twins on larger tables than the other tests use, where rare rules show."""

import duckdb
import pytest

from flowlens.llm import queries

DATA = "/root/testdata/sf0.1"


@pytest.mark.parametrize("name", ["op5_line_dedup", "op8_secrets", "op12_audit"])
def test_twin_states_the_same_rule(name, spark):
    duck = duckdb.connect()
    for table in ("documents", "labels"):
        duck.execute(f"CREATE VIEW {table} AS SELECT * FROM '{DATA}/{table}.parquet'")
    ours = queries.QUERIES[name](spark, DATA).toArrow()
    theirs = duck.sql(queries.SQL[name]).to_arrow_table()
    columns = sorted(ours.column_names)
    assert columns == sorted(theirs.column_names)
    rows = lambda t: sorted(zip(*[t.column(c).to_pylist() for c in columns]))
    assert rows(ours) == rows(theirs)
