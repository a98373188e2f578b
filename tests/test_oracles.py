"""Every registered query against its SQL on the smallest tables, by DuckDB."""

import math
import os

import duckdb
import numpy as np
import pytest

from lumenframe.plans import catalog

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="the driver's tables are not here")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        p = f"{DATA}/{t}.parquet"
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{p + '/*.parquet' if os.path.isdir(p) else p}'")
    return con


def plain(v):
    if isinstance(v, np.generic):
        v = v.item()
    if isinstance(v, float):
        return "nan" if math.isnan(v) else f"{v:.6g}" if v else "0"
    return v


def test_every_query_has_sql():
    assert set(catalog.QUERIES) == set(catalog.ORACLES)
    assert all(isinstance(x, str) for x in catalog.ORACLES.values())


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_query_matches_sql(spark, duck, name):
    df = catalog.QUERIES[name](spark, DATA)
    got = duck.execute(catalog.ORACLES[name])
    cols = [c[0] for c in got.description]
    assert sorted(df.columns) == sorted(cols)
    at = [cols.index(c) for c in df.columns]
    want = sorted(repr([plain(r[i]) for i in at]) for r in got.fetchall())
    assert sorted(repr([plain(v) for v in r]) for r in df.collect()) == want
