"""The queries that SQL can express equal it."""

import glob
import os

import duckdb
import pytest

from harrow.llm import queries


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_equals_sql(spark, sf, name):
    con = duckdb.connect()
    for f in glob.glob(f"{sf}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    df = queries.QUERIES[name](spark, sf)
    got = con.execute(queries.SQL[name])
    names = [x[0] for x in got.description]
    assert sorted(names) == sorted(df.columns)
    assert sorted(tuple(r) for r in df.select(*names).collect()) == sorted(got.fetchall())
