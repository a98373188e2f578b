import os

import duckdb
import pytest

from lumenframe.llm import catalog

DATA = "/root/testdata/sf0.001"


def test_oracles_are_sql():
    assert all(isinstance(x, str) for x in catalog.ORACLES.values())
    assert set(catalog.ORACLES) < set(catalog.QUERIES)


@pytest.mark.skipif(not os.path.isdir(DATA), reason="the driver's tables are not here")
@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_query_matches_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings", "pages", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    df = catalog.QUERIES[name](spark, DATA)
    got = con.execute(catalog.ORACLES[name])
    cols = [c[0] for c in got.description]
    at = [cols.index(c) for c in df.columns]
    assert sorted(repr(tuple(r)) for r in df.collect()) == sorted(repr(tuple(r[i] for i in at)) for r in got.fetchall())
