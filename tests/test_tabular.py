"""Photo lists, checks, sampling, outliers, folds and metrics, rule by rule."""

import math

import pytest
from pyspark.sql import functions as F

from sievework.operators import checks, folds, metrics, outliers, sampling
from sievework.operators.ranking import quantiles, seeded, shuffled_rank
from sievework.schema import TRANSFORMS, DatasetError, Settings
from sievework.sources import manifest
from sievework.sources.settings import from_mapping


def batch(name, cls, n=4):
    return [(f"{name}-{i}", name, cls, f"photos/{name}-{i}.jpg") for i in range(n)]


COLUMNS = "id string, batch_id string, class string, path string"


def photos(spark, *batches):
    return spark.createDataFrame([r for b in batches for r in b], COLUMNS)


def test_manifest_reads_alias_and_keeps_zeros(spark, tmp_path):
    (tmp_path / "m.csv").write_text("id,batch_id,class,Photo photo\n007,01,A,photos/a.jpg\n")
    assert manifest.load_manifest(spark, str(tmp_path / "m.csv")).first().asDict() == {"id": "007", "batch_id": "01", "class": "A", "path": "photos/a.jpg"}


def test_manifest_rejects_columns_and_classes(spark, tmp_path):
    (tmp_path / "m.csv").write_text("id,batch_id,class\n1,1,A\n")
    with pytest.raises(ValueError, match="path"):
        manifest.load_manifest(spark, str(tmp_path / "m.csv"))
    (tmp_path / "n.csv").write_text("id,batch_id,class,path\n1,1,Z,p\n2,1,,p\n")
    with pytest.raises(ValueError, match="None, Z"):
        manifest.load_manifest(spark, str(tmp_path / "n.csv"))


def test_exclusions(spark, tmp_path):
    df = photos(spark, batch("b1", "A"))
    assert manifest.load_exclusions(spark, str(tmp_path / "none.csv")) is None
    kept, dropped = manifest.exclude(df, spark.createDataFrame([("b1-2", "blurred")], "id string, reason string"))
    assert kept.count() == 3 and dropped.first().id == "b1-2"
    with pytest.raises(ValueError, match="b9"):
        manifest.exclude(df, spark.createDataFrame([("b9", "x")], "id string, reason string"))


def test_batch_rules(spark):
    dirty = photos(spark, batch("b1", "A", 3), batch("b2", "A")[:3] + [("b2-3", "b2", "B", "p")], batch("b3", "C")[:3] + [("b3-0", "b3", "C", "p")], [("x", None, "A", "p")])
    found = {(r.batch, r.reason) for r in checks.batch_issues(dirty).collect()}
    assert found == {("b1", "row_count"), ("b2", "class_conflict"), ("b3", "duplicate_id")}
    with pytest.raises(DatasetError, match="3 batch issues"):
        checks.assert_clean(dirty)
    clean = photos(spark, batch("b1", "A"))
    assert checks.assert_clean(clean) is clean


def test_balance_caps_classes(spark):
    df = photos(spark, *[batch(f"{c}{i}", c) for c, n in (("A", 15), ("D", 9), ("F", 10)) for i in range(n)])
    kept, dropped = sampling.balance(df, 0.9, 42)
    assert {r["class"]: r.n for r in kept.groupBy("class").agg(F.count_distinct("batch_id").alias("n")).collect()} == {"A": 10, "D": 9, "F": 10}
    assert dropped.count() == 5 and kept.groupBy("batch_id").count().filter("count <> 4").isEmpty()
    again = sampling.balance(df.repartition(3), 0.9, 42)[1]
    assert sorted(map(tuple, again.collect())) == sorted(map(tuple, dropped.collect()))


def test_multipliers(spark):
    df = spark.createDataFrame([("A",)] * 200 + [("B",)] * 100, "class string")
    assert {r["class"]: r.copies for r in sampling.class_multipliers(df, [], 1, 7).collect()} == {"A": 1, "B": 3}


def test_shuffled_rank_is_a_permutation(spark):
    df = spark.range(5000).select((F.col("id") % 3).alias("k"), "id")
    ranked = shuffled_rank(df, ["k"], seeded(1, "id"), ["id"])
    for r in ranked.groupBy("k").agg(F.min("rank").alias("lo"), F.max("rank").alias("hi"), F.count_distinct("rank").alias("n"), F.count("*").alias("c")).collect():
        assert r.lo == 1 and r.hi == r.n == r.c
    plain = shuffled_rank(df.drop("k"), [], seeded(1, "id"), ["id"])
    assert plain.agg(F.count_distinct("rank")).first()[0] == 5000


def test_quantiles_are_exact(spark):
    df = spark.range(90_001).select((F.col("id") % 2).alias("k"), ((F.col("id") * 7919) % 997).cast("double").alias("v"))
    got = {r.k: r for r in quantiles(df, ["k"], "v", {"a": 0.25, "b": 0.5, "c": 0.99, "d": 0.0, "e": 1.0}).collect()}
    want = {r.k: r.p for r in df.groupBy("k").agg(F.percentile("v", F.array(*map(F.lit, (0.25, 0.5, 0.99, 0.0, 1.0)))).alias("p")).collect()}
    for k, r in got.items():
        assert [r.a, r.b, r.c, r.d, r.e] == pytest.approx(want[k])
    assert quantiles(df.filter("v < 0"), ["k"], "v", {"a": 0.5}).count() == 0


def numbers(spark, values, name):
    return spark.createDataFrame([(str(i), float(v)) for i, v in enumerate(values)], f"id string, {name} double")


def test_outlier_rules(spark):
    tailed = numbers(spark, [-0.1, 0.0, 0.1, 0.2] * 9 + [3.0] + [-10.0, 10.0] * 2, "f")
    flags = {r.value for r in outliers.outlier_values(tailed, ["id"], ["f"]).filter("outlier").collect()}
    assert 3.0 in flags and 10.0 in flags
    spike = numbers(spark, [0.0] * 39 + [10.0], "f")
    assert [r.value for r in outliers.outlier_values(spike, ["id"], ["f"]).filter("outlier").collect()] == [10.0]
    flat = numbers(spark, [5.0] * 20, "f")
    assert outliers.outlier_values(flat, ["id"], ["f"]).filter("outlier").isEmpty()
    gaps = numbers(spark, [float("nan")] + [0.0] * 38 + [10.0], "f")
    assert outliers.outlier_rows(gaps, ["id"], ["f"]).filter("flagged").count() == 1


def test_a_flagged_photo_loses_all_transforms(spark):
    base = numbers(spark, [i * 0.01 for i in range(39)] + [50.0], "feat")
    table = base.select("id", F.lit("b").alias("batch_id"), F.lit("A").alias("class"), F.lit(0.2).alias("mask_fraction"), "feat", F.explode(F.array(*map(F.lit, ("rot0", "rot90", "flip")))).alias("augment"))
    # an outlying copy of a sound original does not count
    table = table.withColumn("feat", F.when((F.col("id") == "3") & (F.col("augment") == "flip"), 900.0).otherwise(F.col("feat")))
    kept, flagged = outliers.remove_outlier_photos(table, Settings())
    assert kept.count() == 39 * 3 and [r.id for r in flagged.collect()] == ["39"]
    assert manifest.feature_columns(table) == ["feat"]
    none = table.drop("feat")
    assert outliers.remove_outlier_photos(none, Settings())[0].count() == 120


def split_frame(spark, n=30):
    return photos(spark, *[batch(f"b{i}", "ABCDEF"[i % 6]) for i in range(n)])


def test_folds_keep_groups_and_classes(spark):
    df = split_frame(spark)
    out = folds.group_folds(df, 5)
    assert out.count() == 30 and out.agg(F.count_distinct("batch_id")).first()[0] == 30
    assert out.groupBy("fold").agg(F.count_distinct("class").alias("n")).filter("n <> 6").isEmpty()
    sizes = [r["count"] for r in folds.group_folds(split_frame(spark, 28), 5).groupBy("fold").count().collect()]
    assert max(sizes) - min(sizes) <= 1
    with pytest.raises(ValueError, match="groups"):
        folds.group_folds(split_frame(spark, 3), 5)
    with pytest.raises(ValueError, match="missing"):
        folds.group_folds(df, 5, group="sample_id")


def test_training_rows_never_meet_validation(spark):
    table = split_frame(spark).withColumn("augment", F.explode(F.array(*map(F.lit, TRANSFORMS)))).withColumn("feat", F.lit(1.0))
    s = Settings()
    folded = folds.with_folds(table, s)
    train, val = folds.train_rows(folded, s), folds.validation_rows(folded)
    assert train.filter("fold = train_fold").isEmpty() and val.filter("augment <> 'rot0'").isEmpty() and val.count() == 120
    met = train.select("train_fold", "batch_id").distinct().join(val.select(F.col("fold").alias("train_fold"), "batch_id").distinct(), ["train_fold", "batch_id"])
    assert met.isEmpty()
    copies = train.groupBy("train_fold", "id").agg(F.count("*").alias("n"), F.count_if(F.col("augment") == "rot0").alias("o"))
    assert copies.filter("o <> 1 or n < 2 or n > 5").isEmpty()
    assert folds.full_training_rows(table, s).count() == 240


def labelled(spark, pairs, model="random_forest", fold=0):
    return spark.createDataFrame([(fold, model, t, p) for t, p in pairs], "fold int, model string, class string, predicted string")


def test_metrics_by_hand(spark):
    y = labelled(spark, [("A", "A"), ("A", "B"), ("B", "B")])
    assert metrics.ordered_matrix(metrics.confusion_cells(y)) == (["A", "B"], [[1, 1], [0, 1]])
    assert metrics.accuracy(y).first()[0] == pytest.approx(2 / 3)
    assert metrics.macro_f1(y).first()[0] == pytest.approx(2 / 3)
    order = labelled(spark, [(c, c) for c in "EAFB"])
    assert metrics.ordered_matrix(metrics.confusion_cells(order))[0] == list("FABE")
    never = labelled(spark, [("A", "B")])
    assert {r["class"]: (r.precision, r.recall) for r in metrics.class_metrics(never).collect()} == {"A": (0.0, 0.0), "B": (0.0, 0.0)}
    assert [r["class"] for r in metrics.per_fold_class_metrics(never).collect()] == ["A"]


def test_pass_marks(spark):
    pairs = [("A", "A")] * 4 + [("B", "A")] * 3 + [("B", "B")]
    y = labelled(spark, pairs).unionByName(labelled(spark, pairs, fold=1))
    scores = spark.createDataFrame([("random_forest", 0, 0.70), ("random_forest", 1, 0.74), ("logistic_regression", 0, 0.60), ("logistic_regression", 1, 0.62)], "model string, fold int, macro_f1 double")
    found = {r.check: r for r in metrics.pass_marks(y, scores, "random_forest", Settings().marks).collect()}
    assert found["macro_f1"].value == pytest.approx(0.72) and not found["macro_f1"].passed
    assert found["min_class_recall"].value == 0.25 and found["min_class_recall"].detail == "B"
    assert found["class_A_precision"].value == pytest.approx(0.5714) and not found["class_A_precision"].passed
    assert found["beats_baseline"].passed
    absent = {r.check: r for r in metrics.pass_marks(labelled(spark, [("B", "B")]), scores.filter("model = 'random_forest'"), "random_forest", Settings().marks).collect()}
    assert math.isnan(absent["class_A_precision"].value) and not absent["class_A_precision"].passed and "beats_baseline" not in absent


def test_selection_is_of_ensembles_only(spark):
    scores = spark.createDataFrame([("logistic_regression", 0.9), ("xgboost", 0.5), ("lightgbm", 0.5)], "model string, macro_f1 double")
    assert metrics.select_model(scores) == "xgboost"
    with pytest.raises(ValueError):
        metrics.select_model(scores.filter("model = 'logistic_regression'"))


def test_class_weights_balance(spark):
    df = spark.createDataFrame([("A",)] * 6 + [("B",)] * 2, "class string")
    assert {r["class"]: r.w for r in metrics.class_weights(df).groupBy("class").agg(F.sum("weight").alias("w")).collect()} == {"A": 4.0, "B": 4.0}


def test_family_shares(spark):
    df = spark.createDataFrame([("color", -3.0), ("edge", 1.0)], "family string, value double")
    assert {r.family: r.share for r in metrics.family_shares(df, []).collect()} == {"color": 0.75, "edge": 0.25}
    assert {r.share for r in metrics.family_shares(df.withColumn("value", F.lit(0.0)), []).collect()} == {0.0}


def test_settings_from_nested_mapping():
    s = from_mapping({"data": {"min_grade_ratio": 0.8}, "features": {"glcm": {"distances": [1]}}, "tuning": {"n_trials": 3}})
    assert s.min_grade_ratio == 0.8 and s.glcm_distances == (1,) and s.n_trials == 3 and s.inner().n_splits == 3 and s.inner(5).n_splits == 5


def test_errors_count_all_cases_and_list_some(spark):
    rows = spark.range(1001).selectExpr("cast(id as string) id", "concat('b', id) batch_id", "'A' class")
    with pytest.raises(checks.DatasetError, match="1001 batch issues.* and 1 more$"):
        checks.assert_clean(rows)
    assert checks.and_more(3, ["a", "b"]) == "a, b and 1 more" and checks.and_more(2, ["a", "b"]) == "a, b"


def test_issues_carry_the_rows(spark):
    df = spark.createDataFrame([("a", "x", "A"), ("b", "x", "B"), ("b", "x", "A"), ("c", "y", "A"), ("d", None, "A")], "id string, batch_id string, class string")
    got = {(r.batch, r.reason): (r.detail, r.rows) for r in checks.batch_issues(df, size=3).collect()}
    assert got == {("x", "class_conflict"): ("classes: A, B", ["a", "b", "b"]), ("x", "duplicate_id"): ("ids: b", ["b"]), ("y", "row_count"): ("rows: 1", ["c"])}


def test_csv_ids_keep_zeros(spark, tmp_path):
    from sievework.sources.manifest import read_table

    (tmp_path / "t.csv").write_text("id,batch_id,class,mask_fraction,glcm_d1\n007,01,A,0.25,3\n")
    r = read_table(spark, str(tmp_path / "t.csv")).first()
    assert (r.id, r.batch_id, r.mask_fraction, r.glcm_d1) == ("007", "01", 0.25, 3)


def test_column_quantiles(spark, monkeypatch):
    import numpy as np

    from sievework.operators import ranking

    rng = np.random.default_rng(3)
    rows = [(float(a), float(b), None, float("nan") if k % 5 else 1.5) for k, (a, b) in enumerate(rng.integers(0, 30, (4000, 2)) * (1.0, 0.25))]
    df = spark.createDataFrame(rows, "a double, b double, c double, d double")
    for enough in (20_000, 100):  # all rows ordered, and brackets alone
        monkeypatch.setattr(ranking, "ENOUGH", enough)
        got = ranking.column_quantiles(df, ["a", "b", "c", "d"], {"q1": 0.25, "q9": 0.901})
        for c, k in (("a", 0), ("b", 1)):
            values = np.array([r[k] for r in rows])
            assert got[c]["q1"] == pytest.approx(np.quantile(values, 0.25)) and got[c]["q9"] == pytest.approx(np.quantile(values, 0.901))
            assert (got[c]["mean"], got[c]["sd"]) == pytest.approx((values.mean(), values.std()))
        assert got["c"] == {"n": 0, "mean": None, "sd": None, "q1": None, "q9": None} and got["d"]["q1"] == 1.5 and got["d"]["n"] == 800


def test_removal_returns_flags(spark):
    df = spark.createDataFrame([(str(k), 1.0 + k % 3, 5.0 if k else 500.0) for k in range(40)], "id string, f double, g double")
    kept, flags = outliers.remove_outliers(df, "id")
    assert kept.count() == 39 and {(r.id, r.f, r.g) for r in flags.filter("f or g").collect()} == {("0", False, True)}


def test_csv_tables_hold_maps_as_json(spark, tmp_path):
    from sievework.sources.manifest import read_table, write_table

    df = spark.createDataFrame([("m", 0, {"a": "1"})], "model string, fold int, params map<string,string>")
    write_table(df, str(tmp_path / "p.csv"), csv=True)
    assert tuple(read_table(spark, str(tmp_path / "p.csv")).first()) == ("m", 0, '{"a":"1"}')
