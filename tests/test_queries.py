"""Every registered query of the library over the smallest tables; those with SQL must give the same rows in DuckDB."""

import os

import duckdb
import pytest

from formweave.plans.catalog import ORACLE_SQL, QUERIES
from formweave.plans.fixtures import TABLES

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")


def plain(v):
    if isinstance(v, bool) or v is None or isinstance(v, str):
        return v
    return round(float(v), 6)


def rows(records, names):
    order = sorted(names)
    key = lambda r: [(x is not None, str(type(x)), x) for x in r]
    return sorted((tuple(plain(r[n]) for n in order) for r in records), key=key)


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, DATA)
    got = [r.asDict() for r in df.collect()]
    if name not in ORACLE_SQL:
        assert df.columns
        return
    cursor = duck.execute(ORACLE_SQL[name])
    names = [d[0] for d in cursor.description]
    want = [dict(zip(names, r)) for r in cursor.fetchall()]
    assert sorted(names) == sorted(df.columns)
    assert rows(got, names) == rows(want, names)
