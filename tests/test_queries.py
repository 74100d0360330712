"""Every registered plan query against its SQL twin on the smallest tables."""

import math
import os

import duckdb
import pytest

from millrace.plans import QUERIES, SQL

FOLDER = "/root/testdata/sf0.001"
NAMES = "customer part orders events documents conversations".split()

pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables here")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in NAMES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    return con


def plain(v):
    if v is None or v != v:
        return None
    if isinstance(v, float):
        return int(v) if math.isfinite(v) and v == int(v) else round(v, 9)
    return v


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    got = QUERIES[name](spark, FOLDER)
    cols = sorted(got.columns)
    cur = duck.execute(SQL[name])
    names = [d[0] for d in cur.description]
    assert cols == sorted(names)
    at = [names.index(c) for c in cols]
    want = sorted((tuple(plain(r[i]) for i in at) for r in cur.fetchall()), key=repr)
    assert sorted((tuple(plain(r[c]) for c in cols) for r in got.collect()), key=repr) == want
