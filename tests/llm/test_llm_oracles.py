"""Every llm query with a SQL counterpart gives the same rows in Spark and DuckDB."""

import glob
import os

import duckdb
import pytest

from reviewloom.llm import queries

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for p in glob.glob(f"{SF}/*.parquet"):
        con.sql(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM read_parquet('{p}')")
    return con


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_same_rows(spark, duck, name):
    got, want = queries.QUERIES[name](spark, SF), duck.sql(queries.ORACLES[name])
    names = sorted(want.columns)
    assert sorted(got.columns) == names
    assert sorted(map(repr, map(tuple, got.select(*names).collect()))) == sorted(map(repr, want.select(*names).fetchall()))
