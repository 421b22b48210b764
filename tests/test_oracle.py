"""Every registered query with SQL against DuckDB on small tables, where these are there."""

import glob
import os
from collections import Counter

import pytest

from loomspan.plans import all_queries

DATA = "/root/testdata/sf0.01"
duckdb = pytest.importorskip("duckdb")
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")


@pytest.fixture(scope="module")
def tables():
    c = duckdb.connect(config={"threads": 2})
    for p in glob.glob(f"{DATA}/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM read_parquet('{p}')")
    return c


def _value(v):
    return round(v, 6) if isinstance(v, float) else v


@pytest.mark.parametrize("name", [n for n, (_, sql) in all_queries().items() if sql])
def test_query(spark, tables, name):
    query, sql = all_queries()[name]
    df = query(spark, DATA)
    found = tables.execute(sql)
    names = [d[0] for d in found.description]
    assert sorted(names) == sorted(df.columns)
    want = Counter(tuple(map(_value, r)) for r in found.fetchall())
    assert Counter(tuple(_value(r[n]) for n in names) for r in df.collect()) == want
