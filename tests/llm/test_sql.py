"""Numbered queries, and the columns of others that SQL can express, against DuckDB."""

from __future__ import annotations

import os

import duckdb
import pytest

from edgeloom.llm import queries

SMALL = "/root/testdata/sf0.01"


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_query_matches_sql(spark, name):
    made = queries.QUERIES[name](spark, SMALL).toPandas()
    db = duckdb.connect()
    for f in os.listdir(SMALL):
        db.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{SMALL}/{f}'")
    wanted = db.execute(queries.SQL[name]).df()
    columns = sorted(wanted.columns)
    assert sorted(made.columns) == columns
    rows = lambda d: sorted(map(str, d[columns].astype(object).where(d[columns].notna(), None).values.tolist()))
    assert rows(made) == rows(wanted)
