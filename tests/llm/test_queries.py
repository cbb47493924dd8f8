"""The queries that SQL expresses, on the smallest stored tables."""

import os
import sys

import duckdb
import pytest

sys.path.insert(0, os.path.join(os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))), "tools"))

from logspark.llm.queries import ORACLES, QUERIES  # noqa: E402
from oracle_check import TABLES, rows_of  # noqa: E402

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for table in TABLES:
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{SF}/{table}.parquet')")
    cur = con.execute(ORACLES[name])
    out = QUERIES[name](spark, SF)
    assert sorted(out.columns) == sorted(d[0] for d in cur.description)
    assert rows_of(out.columns, [tuple(r) for r in out.collect()]) == rows_of([d[0] for d in cur.description], cur.fetchall())
