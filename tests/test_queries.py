"""Registered queries against their SQL, on the smallest tables."""

import math

import duckdb
import pytest

import __spark_entry__ as entry
from sievework.plans import catalog

SLOW = {"nested_cv", "ablation"}


@pytest.fixture(scope="module")
def duck(small):
    c = duckdb.connect()
    for name in "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split():
        c.execute(f"CREATE VIEW {name} AS SELECT * FROM '{small}/{name}.parquet'")
    return c


def plain(rows):
    none = lambda v: v is None or (isinstance(v, float) and math.isnan(v))
    return sorted([tuple("" if none(v) else str(v) for v in r) for r in rows])


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_query_equals_sql(name, spark, small, duck):
    df = catalog.QUERIES[name](spark, small)
    want = duck.execute(catalog.ORACLES[name])
    columns = sorted(c[0] for c in want.description)
    assert sorted(df.columns) == columns
    place = [[c[0] for c in want.description].index(c) for c in columns]
    assert plain(tuple(r) for r in df.select(*columns).collect()) == plain(tuple(r[i] for i in place) for r in want.fetchall())


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.ORACLES) - SLOW))
def test_query_runs(name, spark, small):
    assert catalog.QUERIES[name](spark, small).count() > 0


def test_entry_and_contract(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries()) and set(catalog.QUERIES) <= set(entry.queries())
