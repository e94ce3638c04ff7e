"""Every operator and stage on awkward tables: a defined result, and no crash."""

import pytest

import corpus_pipeline
from sievework.llm import decontamination, licenses, lm, mixing, neardup, pii, secrets, sharding, simhash, toxicity


@pytest.fixture(scope="module")
def field():
    return pii.train_field(40, 1)


@pytest.fixture(scope="module")
def benchmark(spark):
    return spark.createDataFrame([(1, None), (2, ""), (None, "one"), (3, "tail"), (3, "tail")], "item_id long, text string")


def runs(field, benchmark, labels):
    model = lambda df: toxicity.learn(df, labels)
    return {
        "op1": lambda df: licenses.scan_licenses(df),
        "op2": lambda df: toxicity.score_toxicity(df, *model(df)),
        "op3": lambda df: decontamination.find_contamination(df, benchmark),
        "op4": lambda df: secrets.scan_secrets(df),
        "op5": lambda df: neardup.near_duplicates(df),
        "op6": lambda df: mixing.mix(df),
        "op7": lambda df: lm.score_documents(df),
        "op8": lambda df: simhash.fingerprint_documents(df),
        "op9": lambda df: pii.find_personal_data(df, field=field),
        "op10": lambda df: sharding.assign_shards(df),
    }


@pytest.mark.parametrize("name", [f"op{n}" for n in range(1, 11)])
def test_odd_rows_each_have_a_result(name, odd, field, benchmark, labels):
    out = runs(field, benchmark, labels)[name](odd)
    assert out.count() == odd.count()
    ids = sorted(str(r.doc_id) for r in odd.select("doc_id").collect())
    assert sorted(str(r.doc_id) for r in out.select("doc_id").collect()) == ids


@pytest.mark.parametrize("name", [f"op{n}" for n in range(1, 11)])
def test_empty_tables_give_empty_results(name, empty, field, benchmark, labels):
    assert runs(field, benchmark, labels)[name](empty).collect() == []


def by_id(df):
    return {r.doc_id: r for r in df.collect()}


def test_defined_results(spark, odd, benchmark, field):
    lic = by_id(licenses.scan_licenses(odd))
    assert lic[1].n_words == 0 and lic[1].first_word is None and lic[1].base_labels == "" and lic[1].score == 0
    dec = by_id(decontamination.find_contamination(odd, benchmark))
    assert dec[1].n_words == 0 and not dec[1].contaminated and dec[9].n_hit == 1 and dec[9].n_items == 1 and dec[7].n_items == 1
    near = by_id(neardup.near_duplicates(odd))
    assert near[2].n_shingles == 0 and near[2].component_id == 2 and near[2].kept and near[6].component_id == 5 and not near[6].kept
    assert near[None].component_id is None and not near[None].kept and near[9].component_id == 5 and near[7].n_shingles == 1
    mixed = by_id(mixing.mix(odd))
    assert mixed[1].taken == 0 and mixed[1].size == 0
    shards = sharding.assign_shards(odd)
    assert by_id(shards)[1].size == 16 and by_id(shards)[1].text_crc32 == 0 and shards.filter("grown_shard is not null").isEmpty()
    scores = by_id(lm.score_documents(odd))
    assert scores[1].n_tokens == 1 and scores[2].score == scores[1].score
    prints = by_id(simhash.fingerprint_documents(odd))
    assert prints[1].fingerprint == "0" * 16 and prints[5].fingerprint == prints[6].fingerprint and prints[8].n_chars == 18 + prints[6].n_chars


def test_extra_columns_stay_and_outputs_replace(odd, benchmark):
    out = sharding.assign_shards(odd)
    assert out.columns.count("shard") == 1 and out.filter("shard < 0 or size < 16").isEmpty() and out.filter("doc_id = 4").first().comp == -4
    assert mixing.mix(odd).filter("doc_id = 4").first().key == "k"
    assert decontamination.find_contamination(odd, benchmark).filter("doc_id = 4").first().rng == -1


@pytest.mark.parametrize("stage", [name for name, _ in corpus_pipeline.STAGES])
def test_stages(stage, spark, odd, empty, labels, benchmark, tmp_path):
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    benchmark.write.parquet(f"{tmp_path}/benchmark.parquet")
    run = dict(corpus_pipeline.STAGES)[stage]
    for df in (odd, empty):
        docs = df.select("doc_id", "text", "lang", "source", "n_chars", "comp")
        out = run(spark, docs, str(tmp_path))
        assert out.columns[: len(docs.columns)] == docs.columns and (len(out.columns) == len(docs.columns)) == (stage != "sharding")
        assert out.count() <= 3 * df.count()


def test_one_document_of_a_group_stays(spark):
    same, tail = " ".join(f"w{i}" for i in range(40)), " ".join(f"v{i}" for i in range(30))
    rows = [(5, same, "b"), (5, same, "a"), (5, same, "a"), (7, same, "c"), (None, same, "d"), (None, tail, "e"), (None, tail, "f"), (8, "x " + same, "g"), (9, "only here", "h"), (9, "and there", "i"), (9, same + " y", "j"), (1, None, "k"), (1, "", "l"), (None, "", "m"), (None, None, "n")]
    df = spark.createDataFrame(rows, "doc_id long, text string, sid string").repartition(3)
    got = [tuple(r) for r in neardup.keep_one(df).collect()]
    assert sorted((str(i), t) for i, t, _ in got if t) == sorted([("5", same), ("None", tail), ("9", "only here"), ("9", "and there")])
    assert sum(i == 1 for i, *_ in got) == 1 and sum(i is None and not t for i, t, _ in got) == 2
    assert sorted(tuple(map(str, r)) for r in neardup.keep_one(df).collect()) == sorted(tuple(map(str, r)) for r in got)


def test_partners_too_large_to_broadcast_are_met_by_salted_keys(spark, odd, benchmark, field, labels, monkeypatch):
    from sievework.llm import common

    every = runs(field, benchmark, labels) | {"one of a group": neardup.keep_one}
    names = ("op3", "op5", "op8", "op10", "one of a group")
    shown = lambda df: sorted(str(r) for r in df.collect())
    want = {n: shown(every[n](odd)) for n in names}
    monkeypatch.setattr(common, "BROADCAST_ROWS", -1)
    monkeypatch.setattr(neardup, "BROADCAST_IDS", -1)
    monkeypatch.setattr(neardup, "PARTNERS", 1)
    monkeypatch.setattr(sharding, "MOST_ALIKE", 1)
    for n in names:
        assert shown(every[n](odd)) == want[n]
