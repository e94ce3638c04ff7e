"""The pipeline and the toxicity query against plain versions, with missing and repeated ids among the rows."""

import plain
import pytest

import corpus_pipeline
from sievework.llm import toxicity


@pytest.fixture(scope="module")
def tables(spark, small, tmp_path_factory):
    """The smallest tables, with rows repeated, without ids, and with one id for different texts."""
    folder = str(tmp_path_factory.mktemp("tables"))
    docs = spark.read.parquet(f"{small}/documents.parquet")
    rows = [tuple(r) for r in docs.collect()]
    odd = [rows[3], rows[3], (None, *rows[4][1:]), (None, "no id here but a text of some few words of its own", "en", None, 50), (rows[5][0], "the same id and quite another text with words of its own", *rows[5][2:]), (None, None, None, None, None), (10**6, "", "en", "src0", 0)]
    spark.createDataFrame(rows + odd, docs.schema).repartition(5).write.parquet(f"{folder}/documents.parquet")
    for name in ("labels", "benchmark"):
        spark.read.parquet(f"{small}/{name}.parquet").write.parquet(f"{folder}/{name}.parquet")
    return folder


def learned(spark, folder):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{folder}/documents.parquet").collect()]
    labels = {}
    for r in spark.read.parquet(f"{folder}/labels.parquet").collect():
        if r.doc_id is not None and r.toxic is not None:
            labels[r.doc_id] = max(r.toxic, labels.get(r.doc_id, 0))
    return rows, toxicity.train(*plain.toxic_sample(rows, labels))


def test_toxicity_query_is_the_plain_one(spark, tables):
    rows, model = learned(spark, tables)
    got = [(r.doc_id, r.score, r.predicted) for r in toxicity.op2_toxicity(spark, tables).collect()]
    want = {}
    for i, t in rows:
        want.setdefault(i, []).append(plain.toxic_score(model, t))
    assert len(got) == len(rows)
    for i in want:
        assert sorted(s for x, s, _ in got if x == i) == pytest.approx(sorted(want[i]))
    assert all(p == (s >= 0.5) for _, s, p in got) and 0 < sum(p for *_, p in got) < len(got) / 2


def test_pipeline_is_the_plain_one(spark, tables):
    _, model = learned(spark, tables)
    rows = [(r.doc_id, r.text, r.source) for r in spark.read.parquet(f"{tables}/documents.parquet").collect()]
    steps = [len(rows)]
    rows = [r for r in rows if plain.toxic_score(model, r[1]) < 0.5]
    steps.append(len(rows))
    rows = plain.deduplicated(rows)
    steps.append(len(rows))
    windows = plain.benchmark_windows(r.text for r in spark.read.parquet(f"{tables}/benchmark.parquet").collect())
    rows = [r for r in rows if not plain.contaminated(r[1], windows)]
    steps.append(len(rows))
    assert steps == sorted(set(steps), reverse=True)  # every stage so far takes something out
    want = plain.sharded(plain.mixed(rows))
    got = [(r.doc_id, r.text, r.source, r.size, r.shard, r.slot) for r in corpus_pipeline.run(spark, tables).collect()]
    key = lambda r: tuple((x is None, x or 0) if not isinstance(x, str) else (False, x) for x in (*r[3:], r[1] or "", r[0]))
    assert sorted(got, key=key) == sorted(want, key=key)
