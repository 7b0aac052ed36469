"""Every query with SQL gives the SQL's rows on the smallest tables."""

import os

import duckdb
import pytest

from strataq.plans import queries as Q

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return c


def plain(v):
    return tuple(map(plain, v)) if isinstance(v, list) else v


@pytest.mark.skipif(not os.path.isdir(DATA), reason="the driver's tables aren't here")
@pytest.mark.parametrize("name", sorted(Q.SQL))
def test_equals_sql(spark, duck, name):
    df = Q.QUERIES[name](spark, DATA)
    got = df.collect()
    want = duck.sql(Q.SQL[name])
    names, rows = want.columns, want.fetchall()
    assert sorted(names) == sorted(df.columns)
    key = lambda r: tuple((x is None, str(x)) for x in r)
    assert sorted((tuple(plain(r[n]) for n in names) for r in got), key=key) == sorted((tuple(map(plain, r)) for r in rows), key=key)


@pytest.mark.skipif(not os.path.isdir(DATA), reason="the driver's tables aren't here")
@pytest.mark.parametrize("name", sorted(set(Q.QUERIES) - set(Q.SQL)))
def test_runs(spark, name):
    assert Q.QUERIES[name](spark, DATA).count() > 0
