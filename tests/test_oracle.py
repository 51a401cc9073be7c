"""Each query with a SQL twin against DuckDB, over the smallest tables; the others must give rows."""

from __future__ import annotations

import math

import duckdb
import pytest

from tilewright import registry

from .conftest import SMALL

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SMALL}/{t}.parquet'")
    return c


def cell(v) -> str:
    if v is None:
        return "null"
    return ("nan" if math.isnan(v) else repr(v + 0.0)) if isinstance(v, float) else str(v)


@pytest.mark.parametrize("name", sorted(registry.SQL))
def test_query_agrees_with_sql(spark, con, name):
    df = registry.QUERIES[name](spark, SMALL)
    got = sorted([cell(r[c]) for c in sorted(df.columns)] for r in df.collect())
    found = con.execute(registry.SQL[name])
    names = [d[0] for d in found.description]
    order = sorted(range(len(names)), key=lambda i: names[i])
    assert sorted(names) == sorted(df.columns)
    assert got == sorted([cell(r[i]) for i in order] for r in found.fetchall())


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.SQL)))
def test_other_query_gives_rows(spark, name):
    assert registry.QUERIES[name](spark, SMALL).count() > 0


def test_sql_has_its_query():
    assert set(registry.SQL) <= set(registry.QUERIES)
