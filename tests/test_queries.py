"""Each query against its SQL on the small tables; queries without SQL run and keep their columns."""

import os

import duckdb
import pandas as pd
import pytest

from sparkbars.plans import jobs, oracles, queries, streams

QUERIES, SQL = {**queries.QUERIES, **streams.QUERIES, **jobs.JOBS}, {**queries.SQL, **streams.SQL, **oracles.SQL}


@pytest.fixture(scope="module")
def duck(small):
    con = duckdb.connect()
    for file in os.listdir(small):
        con.sql(f"CREATE VIEW {file.removesuffix('.parquet')} AS SELECT * FROM '{small}/{file}'")
    return con


def plain(x):
    if x is None or x is pd.NaT or (isinstance(x, float) and x != x):
        return None
    return x if isinstance(x, (bool, str)) else float(x) if isinstance(x, (int, float)) or hasattr(x, "is_integer") else str(x)


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_agrees_with_sql(spark, small, duck, name):
    df = QUERIES[name](spark, small)
    got = [tuple(map(plain, (r[c] for c in sorted(df.columns)))) for r in df.collect()]
    rel = duck.sql(SQL[name])
    assert sorted(df.columns) == sorted(rel.columns)
    at = [rel.columns.index(c) for c in sorted(rel.columns)]
    want = [tuple(plain(r[k]) for k in at) for r in rel.fetchall()]
    assert sorted(got, key=str) == sorted(want, key=str)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_query_runs(spark, small, name):
    df = QUERIES[name](spark, small)
    assert len(set(df.columns)) == len(df.columns)
    df.limit(5).collect()
