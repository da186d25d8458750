"""Every registered query runs on the smallest tables and equals its SQL in DuckDB, where it has one."""

import glob
import math
import os

import duckdb
import pytest

from harrow.plans import registry

registry.load()


def plain(v):
    if isinstance(v, bool) or v is None:
        return str(v)
    if isinstance(v, float):
        return "nan" if math.isnan(v) else f"{v:.9g}"
    if isinstance(v, int):
        return str(v)
    return f"{float(v):.9g}" if hasattr(v, "as_integer_ratio") else str(v)


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for f in glob.glob(f"{sf}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return con


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_equals_sql(spark, sf, duck, name):
    df = registry.QUERIES[name](spark, sf)
    columns = sorted(df.columns)
    rows = sorted(tuple(plain(r[c]) for c in columns) for r in df.collect())
    if name in registry.SQL:
        got = duck.execute(registry.SQL[name])
        names = [x[0] for x in got.description]
        assert sorted(names) == columns
        at = [names.index(c) for c in columns]
        assert rows == sorted(tuple(plain(r[i]) for i in at) for r in got.fetchall())


def test_every_sql_has_a_query():
    assert set(registry.SQL) <= set(registry.QUERIES)
