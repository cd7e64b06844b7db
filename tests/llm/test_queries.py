"""The queries that SQL can express, against their check SQL."""

import os

import duckdb
import pytest

from labelproof.llm import queries

FOLDER = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.CHECKS))
def test_query_equals_its_check(spark, name):
    frame = queries.QUERIES[name](spark, FOLDER)
    columns = sorted(frame.columns)
    got = sorted(str([r[c] for c in columns]) for r in frame.collect())
    con = duckdb.connect()
    for table in ("documents", "conversations", "benchmark"):
        path = f"{FOLDER}/{table}.parquet"
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{path + '/*.parquet' if os.path.isdir(path) else path}'")
    cursor = con.execute(queries.CHECKS[name])
    names = [c[0] for c in cursor.description]
    assert sorted(names) == columns
    assert got == sorted(str([dict(zip(names, r, strict=True))[c] for c in columns]) for r in cursor.fetchall())
