"""Every query with SQL gives what DuckDB gives."""

import glob
import os

import duckdb
import pytest

from surveyloom.plans.catalogue import QUERIES, SQL

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for p in glob.glob(f"{SF}/*.parquet"):
        c.execute(f"create view {os.path.basename(p)[:-8]} as select * from '{p}'")
    return c


@pytest.mark.parametrize("name", sorted(SQL))
def test_query(spark, con, name):
    frame = QUERIES[name](spark, SF)
    got = con.execute(SQL[name])
    columns = sorted(c[0] for c in got.description)
    at = [[c[0] for c in got.description].index(c) for c in columns]
    assert sorted(frame.columns) == columns
    want = sorted(repr(tuple(r[i] for i in at)) for r in got.fetchall())
    assert sorted(repr(tuple(r[c] for c in columns)) for r in frame.collect()) == want
