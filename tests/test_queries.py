"""Every query of the engine against DuckDB on the smallest tables."""

import math

import duckdb
import pytest

from patraflow.plans.oracle import oracle_sql
from patraflow.plans.queries import queries

DIR = "/root/testdata/sf0.001"
TABLES = ["documents", "conversations", "embeddings"]


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS FROM '{DIR}/{t}.parquet'")
    return con


def plain(v):
    return "nan" if isinstance(v, float) and math.isnan(v) else v


@pytest.mark.parametrize("name", sorted(queries()))
def test_query(spark, duck, name):
    df = queries()[name](spark, DIR)
    columns = sorted(df.columns)
    got = [tuple(plain(r[c]) for c in columns) for r in df.collect()]
    assert got
    if (sql := oracle_sql().get(name)) is not None:
        out = duck.sql(sql)
        assert sorted(out.columns) == columns
        at = [out.columns.index(c) for c in columns]
        assert sorted(map(repr, got)) == sorted(repr(tuple(plain(r[i]) for i in at)) for r in out.fetchall())
