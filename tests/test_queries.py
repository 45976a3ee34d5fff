"""Every query of the library that has an oracle, against DuckDB at the smallest scale."""

import glob
import math
import os

import duckdb
import pytest

from chunkweave.plans import corpus_queries as Q

DIR = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DIR), reason="no test data")


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for p in glob.glob(f"{DIR}/*.parquet"):
        con.sql(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    return con


def same(v):
    if isinstance(v, float):
        return None if math.isnan(v) else repr(round(v, 9) + 0.0)
    return None if v is None else str(v)


@pytest.mark.parametrize("name", sorted(Q.ORACLE_SQL))
def test_query(spark, db, name):
    df = Q.QUERIES[name](spark, DIR)
    names = sorted(df.columns)
    said = db.sql(Q.ORACLE_SQL[name])
    assert sorted(said.columns) == names
    at = [said.columns.index(c) for c in names]
    want = sorted(tuple(same(r[i]) or "" for i in at) for r in said.fetchall())
    assert sorted(tuple(same(r[c]) or "" for c in names) for r in df.collect()) == want
