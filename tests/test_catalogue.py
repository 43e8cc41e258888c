"""Every query against its SQL on the smallest tables."""

import math

import duckdb
import pytest

from corpusloom.plans import catalogue

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def db(data):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{data}/{t}.parquet'")
    return con


def like(a, b):
    if isinstance(a, float) and b is not None:
        return math.isclose(a, float(b), abs_tol=1e-6)
    return a == b or str(a) == str(b)


@pytest.mark.parametrize("name", sorted(catalogue.SQL))
def test_equals_sql(spark, db, data, name):
    df = catalogue.QUERIES[name](spark, data)
    got = [tuple(r) for r in df.select(*sorted(df.columns)).collect()]
    r = db.execute(catalogue.SQL[name])
    names = [c[0] for c in r.description]
    assert sorted(names) == sorted(df.columns)
    order = sorted(range(len(names)), key=names.__getitem__)
    want = [tuple(row[i] for i in order) for row in r.fetchall()]
    key = lambda row: tuple((v is not None, str(v)) for v in row)
    got, want = sorted(got, key=key), sorted(want, key=key)
    assert len(got) == len(want)
    for g, w in zip(got, want, strict=True):
        assert all(map(like, g, w)), (g, w)


def test_every_query_has_sql():
    assert set(catalogue.QUERIES) == set(catalogue.SQL)
