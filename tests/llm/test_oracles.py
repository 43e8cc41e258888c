"""Queries against their SQL."""

import duckdb
import pytest

from corpusloom.llm import queries


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_equals_sql(spark, data, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{data}/{t}.parquet'")
    got = queries.QUERIES[name](spark, data)
    r = con.execute(queries.SQL[name])
    names = [c[0] for c in r.description]
    assert names == got.columns
    assert sorted(map(str, r.fetchall())) == sorted(str(tuple(x)) for x in got.collect())


def test_names():
    assert [n.split("_")[0] for n in queries.QUERIES] == [f"op{n}" for n in range(1, 11)] + ["pipeline"]
