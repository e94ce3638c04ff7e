"""The contract's queries: registered, and equal to their SQL on the smallest tables."""

import duckdb
import pytest

import __spark_entry__ as entry
from sievework.llm import catalog


def plain(rows):
    none = lambda v: v is None or v != v
    return sorted([tuple("" if none(v) else str(v) for v in r) for r in rows])


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_query_equals_sql(name, spark, small):
    c = duckdb.connect()
    for t in ("documents", "benchmark"):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{small}/{t}.parquet'")
    df = catalog.QUERIES[name](spark, small)
    want = c.execute(catalog.ORACLES[name])
    columns = sorted(x[0] for x in want.description)
    assert sorted(df.columns) == columns
    place = [[x[0] for x in want.description].index(x) for x in columns]
    assert plain(tuple(r) for r in df.select(*columns).collect()) == plain(tuple(r[i] for i in place) for r in want.fetchall())


def test_all_ten_and_the_pipeline_are_registered(spark, small):
    names = entry.queries()
    assert {f"op{n}" for n in range(1, 11)} == {k.split("_")[0] for k in names if k.startswith("op")} and "pipeline" in names


def test_pipeline_against_its_stages(spark, small):
    """run() is the stages one after the other, and every decision shows in its rows."""
    import corpus_pipeline as p
    from sievework.llm.common import table

    docs = table(spark, small, "documents")
    left, seen = {r.doc_id for r in docs.select("doc_id").collect()}, []
    for name, stage in p.STAGES:
        docs = p.durable(stage(spark, docs, small), "test")
        now = {r.doc_id for r in docs.select("doc_id").collect()}
        assert now <= left
        seen.append((name, len(now)))
        left = now
    assert seen[0][1] < 200 and seen[1][1] < seen[0][1]
    out = p.run(spark, small)
    assert sorted((r.doc_id, r.shard, r.slot) for r in out.collect()) == sorted((r.doc_id, r.shard, r.slot) for r in docs.collect())
