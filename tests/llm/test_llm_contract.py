"""The training-data queries against their SQL on the smallest tables."""

import glob
import os

import duckdb
import pytest

from claimloom.llm.queries import QUERIES, SQL
from tests.test_contract import norm  # noqa: E402


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for p in glob.glob("/root/testdata/sf0.001/*.parquet"):
        c.execute(f"create view {os.path.basename(p)[:-8]} as select * from '{p}'")
    return c


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, sf, name):
    df = QUERIES[name](spark, sf)
    columns = sorted(df.columns)
    rows = sorted((tuple(norm(r[c]) for c in columns) for r in df.collect()), key=repr)
    if name.endswith("_found"):
        assert len(rows) == len(set(rows))
    if name in SQL:
        got = con.execute(SQL[name])
        names = [d[0] for d in got.description]
        assert sorted(names) == columns
        assert sorted((tuple(norm(r[names.index(c)]) for c in columns) for r in got.fetchall()), key=repr) == rows
