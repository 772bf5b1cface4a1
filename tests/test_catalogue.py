"""Every catalogue query against its SQL on the smallest tables."""

import glob
import os

import duckdb
import pytest

from sparkweft.plans.catalogue import ORACLES, QUERIES

DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for p in glob.glob(f"{DIR}/*.parquet"):
        name = os.path.basename(p).removesuffix(".parquet")
        con.sql(f"CREATE VIEW {name} AS SELECT * FROM '{p if os.path.isfile(p) else p + '/*.parquet'}'")
    return con


def plain(x):
    return f"{x:.9g}" if isinstance(x, float) else str(x)


@pytest.mark.skipif(not os.path.isdir(DIR), reason="no test tables")
@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, DIR)
    cols = sorted(df.columns)
    got = sorted(tuple(plain(r[c]) for c in cols) for r in df.collect())
    if name not in ORACLES:
        return
    rel = duck.sql(ORACLES[name])
    at = [rel.columns.index(c) for c in cols]
    assert sorted(rel.columns) == cols
    assert got == sorted(tuple(plain(r[i]) for i in at) for r in rel.fetchall())
