"""Models, tuning, explanations, artifacts, images and scoring, on small tables."""

import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from sievework.operators import explain, features, models
from sievework.operators.metrics import accuracy, class_metrics, class_weights, macro_f1, macro_f1_value
from sievework.operators.models import SPACES, Range, Search, fit_model, suggest_params
from sievework.plans import learning, training
from sievework.schema import MODELS, TRANSFORMS, Settings
from sievework.sources import images
from sievework.sources.artifact import load_artifact, save_artifact
from sievework.streaming.score import score

FOREST = {"n_estimators": 5, "max_depth": 4}


def blobs(spark, n=40, classes="ABCDE", spread=0.5, step=4.0):
    rng = np.random.default_rng(0)
    rows = [(f"{c}{i}", f"{c}{i // 4}", c, *(float(v) for v in rng.normal(step * k, spread, 3))) for k, c in enumerate(classes) for i in range(n)]
    return spark.createDataFrame(rows, "id string, batch_id string, class string, glcm_x double, hsv_y double, edge_z double").cache()


COLUMNS = ["glcm_x", "hsv_y", "edge_z"]


@pytest.mark.parametrize("name,params", [("random_forest", FOREST), ("logistic_regression", {"C": 1.0}), ("xgboost", {"n_estimators": 2, "max_depth": 2, "reg_alpha": 1.0})])
def test_models_learn_blobs(spark, name, params):
    df = blobs(spark, 20, "ABC")
    if name == "xgboost":
        with pytest.warns(UserWarning, match="reg_alpha"):
            model = fit_model(name, params, df, COLUMNS, 1)
    else:
        model = fit_model(name, params, df, COLUMNS, 1)
    assert model.classes == ["A", "B", "C"] and accuracy(model.predict(df)).first()[0] > 0.95
    unlabelled = df.select("edge_z", "glcm_x", "hsv_y", "id")
    assert model.predict(unlabelled).count() == 60
    with pytest.raises(KeyError):
        model.predict(df.drop("hsv_y"))


def test_rare_classes_are_not_given_up(spark):
    rng = np.random.default_rng(1)
    rows = [("A", *map(float, rng.normal(0, 1, 2))) for _ in range(200)] + [("B", *map(float, rng.normal(1.2, 1, 2))) for _ in range(10)]
    df = spark.createDataFrame(rows, "class string, f1 double, f2 double")
    model = fit_model("logistic_regression", {"C": 1.0}, df, ["f1", "f2"], 1)
    assert next(r for r in class_metrics(model.predict(df)).collect() if r["class"] == "B").called >= 10


def test_unknown_model(spark):
    with pytest.raises(ValueError, match="no model"):
        fit_model("svm", {}, blobs(spark, 4), COLUMNS, 1)


def test_search_is_seeded_and_stays_in_range():
    def best(seed):
        s = Search(SPACES["lightgbm"], seed)
        for _ in range(25):
            p = suggest_params("lightgbm", s)
            for k, dim in SPACES["lightgbm"].items():
                assert dim.low <= p[k] <= dim.high and isinstance(p[k], int) == dim.whole
            s.tell(p, -abs(p["subsample"] - 0.8))
        return s.best

    assert best(1) == best(1) and abs(best(1)[0]["subsample"] - 0.8) < 0.1
    with pytest.raises(ValueError):
        suggest_params("xgboost", Search(SPACES["lightgbm"], 1))
    assert Range(1, 3).at(0.999) == 3 and Range(1e-3, 10.0, True).at(0.0) == pytest.approx(1e-3)


def test_nested_validation_never_tunes_on_its_fold(spark, monkeypatch):
    table = blobs(spark, 16, "ABC").withColumn("augment", F.explode(F.array(*map(F.lit, TRANSFORMS[:2])))).cache()
    seen = []
    plain = training.tune_model

    def spy(name, photos, *a, **k):
        seen.append({r.id for r in photos.select("id").distinct().collect()})
        return plain(name, photos, *a, **k)

    monkeypatch.setattr(training, "tune_model", spy)
    s = Settings(n_splits=2, inner_n_splits=2)
    found = training.cross_validate(table, s, ("random_forest",), 1, learning.SMALL)
    for k, ids in enumerate(seen):
        assert not ids & {r.id for r in found.predictions.filter(F.col("fold") == k).select("id").collect()}
    assert found.predictions.count() == 48 and found.scores.count() == 2 and found.params.count() == 2
    with pytest.raises(ValueError, match="deployment"):
        training.fit_final(table, s, "logistic_regression", 1)


def test_cross_validation_makes_folds_once_and_fits_from_written_rows(spark, monkeypatch):
    """Every fit planned all that lies before its rows, and each model made the same inner folds again."""
    table = blobs(spark, 16, "ABC").withColumn("augment", F.explode(F.array(*map(F.lit, TRANSFORMS[:2])))).cache()
    made, plans = [], []
    folds, fit = training.with_folds, models.RandomForestClassifier.fit
    monkeypatch.setattr(training, "with_folds", lambda *a, **k: made.append(1) or folds(*a, **k))
    monkeypatch.setattr(models.RandomForestClassifier, "fit", lambda self, df, *a: plans.append(df._jdf.queryExecution().analyzed().toString()) or fit(self, df, *a))
    found = training.cross_validate(table, Settings(n_splits=2, inner_n_splits=2), ("random_forest", "logistic_regression"), 1, learning.SMALL)
    assert len(made) == 3  # the outer folds, and the inner ones of each
    assert len(plans) == 6 and not [p for p in plans if "Window" in p or "Join" in p or "Generate" in p]
    assert {r.model: r.n for r in found.predictions.groupBy("model").agg(F.count_distinct("id").alias("n")).collect()} == {"random_forest": 48, "logistic_regression": 48}


def test_unused_copies_are_not_assembled(spark):
    """A copy that no fold trains on may have values that no model takes."""
    table = blobs(spark, 8, "AB").withColumn("augment", F.explode(F.array(*map(F.lit, TRANSFORMS[:2])))).withColumn("glcm_x", F.when(F.col("augment") == "rot0", F.col("glcm_x")))
    s = Settings(n_splits=2, inner_n_splits=2, base_copies=0, max_copies=0)
    assert training.cross_validate(table, s, ("random_forest",), 1, learning.SMALL).predictions.count() == 16


def test_macro_f1_as_a_number(spark):
    rng = random.Random(3)
    rows = [(rng.choice(["A", "B", "C", None]), rng.choice(["A", "B", "D"])) for _ in range(300)]
    df = spark.createDataFrame(rows, "class string, predicted string")
    assert macro_f1_value(df) == pytest.approx(macro_f1(df).first().macro_f1, abs=1e-12)
    with pytest.raises(ValueError):
        macro_f1_value(df.limit(0))


def test_fit_weighs_and_orders_classes_as_tables_do(spark):
    rng = np.random.default_rng(4)
    rows = [(c, *map(float, rng.normal(k, 1, 2))) for k, (c, n) in enumerate([("b", 30), ("A", 8), ("é", 4)]) for _ in range(n)] + [(None, 0.0, 0.0)]
    df = spark.createDataFrame(rows, "class string, f1 double, f2 double")
    seen, fit = [], models.RandomForestClassifier.fit
    models.RandomForestClassifier.fit = lambda self, d, *a: seen.append(d.select("class", "weight").distinct().collect()) or fit(self, d, *a)
    try:
        model = fit_model("random_forest", FOREST, df, ["f1", "f2"], 1)
    finally:
        models.RandomForestClassifier.fit = fit
    assert model.classes == ["A", "b", "é"]
    want = {r["class"]: r.weight for r in class_weights(df).select("class", "weight").distinct().collect() if r["class"]}
    assert {r["class"]: r.weight for r in seen[0]} == want


def test_background_leak(spark):
    rng = np.random.default_rng(2)
    rows = [(f"b{i}", "ABCDE"[i % 5], float(10 * (i % 5) + rng.normal()), float(rng.normal())) for i in range(50) for _ in range(4)]
    df = spark.createDataFrame(rows, "batch_id string, class string, paper_l_mean double, paper_l_std double").cache()
    leak = training.paper_accuracy(df, Settings(n_splits=2)).first()
    assert leak.mean_accuracy > 0.9 and leak.leak and leak.chance == 0.2 and leak.n_photos == 200
    blind = training.paper_accuracy(df.withColumn("paper_l_mean", F.col("paper_l_std") * 2), Settings(n_splits=2)).first()
    assert blind.mean_accuracy < 0.4


def test_ablation_report(spark):
    rows = spark.createDataFrame([("m", "texture", 0, 0.5), ("m", "color", 0, 0.5), ("m", "combined", 0, 0.4)], "model string, features string, fold int, macro_f1 double")
    r = training.ablation_report(rows).first()
    assert (r.best_single_family, r.best_mean, r.combined_not_lower) == ("color", 0.5, False)


def test_ablation_fits_from_written_rows(spark, monkeypatch):
    table = blobs(spark, 16, "ABC").drop("hsv_y", "edge_z").withColumn("augment", F.explode(F.array(*map(F.lit, TRANSFORMS[:2])))).cache()
    plans, fit = [], models.RandomForestClassifier.fit
    monkeypatch.setattr(models.RandomForestClassifier, "fit", lambda self, df, *a: plans.append(df._jdf.queryExecution().analyzed().toString()) or fit(self, df, *a))
    combined = spark.createDataFrame([("random_forest", k, 0.1) for k in range(2)], "model string, fold int, macro_f1 double")
    report = training.ablation(table, combined, Settings(n_splits=2, inner_n_splits=2), ("random_forest",), 1, learning.SMALL)[1].first()
    assert report.best_single_family == "texture" and report.best_mean > 0.9 and not report.combined_not_lower
    assert len(plans) == 6 and not [p for p in plans if "Window" in p or "Join" in p or "Generate" in p]


def test_families_share_folds_and_score_as_alone(spark, monkeypatch):
    """Every family made the same folds again, outer and inner."""
    table = blobs(spark, 16, "ABC", spread=4.0).withColumn("augment", F.explode(F.array(*map(F.lit, TRANSFORMS[:2])))).cache()
    s, names = Settings(n_splits=2, inner_n_splits=2), ("logistic_regression",)
    space = {names[0]: {"C": Range(0.1, 10.0, True), "l1_ratio": (0.0,)}}
    alone = {(c, r.fold): r.macro_f1 for c in ("glcm_x", "hsv_y", None) for r in training.cross_validate(table.select("id", "batch_id", "class", "augment", *([c] if c else COLUMNS)), s, names, 1, space).scores.collect()}
    made, folds = [], training.with_folds
    monkeypatch.setattr(training, "with_folds", lambda *a, **k: made.append(1) or folds(*a, **k))
    combined = spark.createDataFrame([(names[0], k, 0.1) for k in range(2)], "model string, fold int, macro_f1 double")
    given = {(r.features, r.fold): r.macro_f1 for r in training.ablation(table, combined, s, names, 1, space)[0].collect()}
    assert len(made) == 3  # the outer folds, and the inner ones of each
    own = {(r.features, r.fold): r.macro_f1 for r in training.ablation(table, None, s, names, 1, space)[0].collect()}
    assert len(made) == 6 and len(own) == len(given) == 8
    for k in range(2):
        assert given["combined", k] == 0.1 and own["combined", k] == alone[None, k]
        for family, c in (("texture", "glcm_x"), ("color", "hsv_y")):
            assert given[family, k] == own[family, k] == alone[c, k]


def whole_job(spark, small, monkeypatch, name):
    """What a query fits, and its outer folds, with the fits themselves left out."""
    fits, made, freed, plain = [], [], [], training.make_folds
    one = spark.createDataFrame([("0", "b", "0", "0")], "id string, batch_id string, class string, predicted string").cache()
    monkeypatch.setattr(training, "make_folds", lambda *a, **k: made.append((a[2], plain(*a, **k))) or made[-1][1])
    monkeypatch.setattr(training.Folds, "fit", lambda self, model, params, k, seed: fits.append((self.vector, model, len(self.counts), k, params)))
    monkeypatch.setattr(training.Folds, "predict", lambda self, model, k: one)
    monkeypatch.setattr(training, "macro_f1_value", lambda rows: 0.5)
    monkeypatch.setattr(training, "collect", lambda s: freed.append(len(fits)))
    monkeypatch.setattr(training, "Search", lambda space, seed: Search(space, seed, warm_up=75))  # as scores say nothing
    rows = learning.QUERIES[name](spark, small).collect()
    assert [(s.n_splits, len(f.counts)) for s, f in made] == [(5, 5)] + [(3, 3)] * 5
    assert len(freed) == sum(n == 3 for _, _, n, _, _ in fits) / 3  # after every trial
    for _, model, _, _, params in fits:
        assert set(params) == set(SPACES[model])
        for p, dim in SPACES[model].items():
            assert dim.low <= params[p] <= dim.high if isinstance(dim, Range) else params[p] in dim
    return rows, Counter(f[:4] for f in fits), made[0][1].counts


def copied(spark, small):
    """Training rows of each outer fold and class, by the published rule: a copy at least, four at most."""
    folded = training.with_folds(learning.vector_table(spark, small, augmented=False), Settings()).groupBy("fold", "class").count().collect()
    out = {}
    for k in range(5):
        n = Counter()
        for r in folded:
            n[r["class"]] += r["count"] * (r.fold != k)
        out[k] = {c: m * (1 + min(4, max(1, round(2 * max(n.values()) / m) - 1))) for c, m in n.items()}
        assert len({out[k][c] / n[c] for c in n}) > 1
    return out


def test_ablation_is_the_published_job(spark, small, monkeypatch):
    """It had two folds, two trials, one small forest and one copy a photo at most."""
    rows, fits, counts = whole_job(spark, small, monkeypatch, "ablation")
    vectors = [f"{models.VECTOR}_{i}" for i in range(4)]  # all features and three families
    assert fits == {(v, m, n, k): 375 if n == 3 else 1 for v in vectors for m in MODELS for n in (3, 5) for k in range(n)}
    assert sorted(r.model for r in rows) == sorted(MODELS) and counts == copied(spark, small)


def test_nested_cv_is_the_published_job(spark, small, monkeypatch):
    """It had two folds, two trials, two small models and one copy a photo at most."""
    rows, fits, counts = whole_job(spark, small, monkeypatch, "nested_cv")
    assert fits == {(f"{models.VECTOR}_0", m, n, k): 375 if n == 3 else 1 for m in MODELS for n in (3, 5) for k in range(n)}
    assert sorted((r.model, r.fold) for r in rows) == [(m, k) for m in sorted(MODELS) for k in range(5)] and counts == copied(spark, small)


def brute_shapley(tree, x):
    """By all orders, with subtrees averaged by cover where a feature is not known."""
    from itertools import permutations

    d = len(x)

    def value(known, node=0):
        if tree.feature[node] < 0:
            return tree.value[node]
        l, r = tree.left[node], tree.right[node]
        if tree.feature[node] in known:
            return value(known, l if x[tree.feature[node]] <= tree.threshold[node] else r)
        return (tree.cover[l] * value(known, l) + tree.cover[r] * value(known, r)) / tree.cover[node]

    out = np.zeros((d, tree.value.shape[1]))
    orders = list(permutations(range(d)))
    for order in orders:
        known = set()
        for f in order:
            before = value(known)
            known.add(f)
            out[f] += (value(known) - before) / len(orders)
    return out


@pytest.mark.parametrize("name", ["random_forest", "xgboost"])
def test_shapley_values(spark, name):
    df = blobs(spark, 20, "ABC", spread=3.0)
    model = fit_model(name, {"n_estimators": 2, "max_depth": 3}, df, COLUMNS, 3)
    trees, n = explain.ensemble(model)
    rng = random.Random(1)
    for _, tree in trees:
        rows = np.array([[rng.uniform(-3, 11) for _ in range(3)] for _ in range(3)])
        for x, got in zip(rows, tree.shapley(rows), strict=True):
            assert np.allclose(got, brute_shapley(tree, x), atol=1e-9)
            assert np.allclose(got.sum(axis=0) + tree.mean(), tree.at(x), atol=1e-9)
    values = explain.shapley_values(model, df.limit(5))
    assert values.count() == 5 * 3 * n
    shares = explain.explain_predictions(model, df.limit(5)).groupBy("id").agg(F.sum("share").alias("s")).collect()
    assert all(r.s == pytest.approx(1.0) for r in shares)
    assert {r.family for r in explain.importance_by_family(values).collect()} == {"texture", "color", "edge"}


@pytest.fixture(scope="module")
def photo_dir(tmp_path_factory):
    folder = tmp_path_factory.mktemp("photos")
    for name, body in learning.generated_photos(2):
        (folder / f"{name}.png").write_bytes(body)
    (folder / "blank.png").write_bytes(images.png(np.full((96, 128, 3), 140, np.uint8)))
    (folder / "broken.png").write_bytes(b"\x89PNG\r\n\x1a\nnothing")
    (folder / "empty.png").write_bytes(b"")
    (folder / "cat.gif").write_bytes(b"GIF89a")
    return str(folder)


def named(spark, folder):
    return images.read_images(spark, folder).select(F.regexp_extract("origin", r"([^/]+)\.\w+$", 1).alias("id"), F.lit("b").alias("batch_id"), F.lit("A").alias("class"), "image")


def test_features_of_photos(spark, photo_dir):
    s = Settings(resize_to=(48, 48))
    table, skipped = features.feature_table(named(spark, photo_dir), s)
    rows = table.groupBy("id").agg(F.count("*").alias("n"), F.min("mask_fraction").alias("m")).collect()
    assert {r.id: r.n for r in rows} == {"p0": 8, "p1": 8} and all(0.05 < r.m < 0.5 for r in rows)
    assert table.columns[5:] == features.feature_names(s) and len(features.feature_names(s)) == 65
    assert {r.id for r in skipped.collect()} >= {"blank", "broken"}
    only = features.feature_table(named(spark, photo_dir), s, ("rot0",))[0]
    assert only.count() == 2
    a, b = (table.filter(f"id = 'p0' and augment = '{t}'").first() for t in ("rot0", "rot90"))
    assert a.glcm_d1_a0_contrast == pytest.approx(b.glcm_d1_a90_contrast, rel=0.1)  # scaling is not symmetric
    assert features.paper_table(named(spark, photo_dir), 110).filter("paper_l_mean > 0").count() >= 3


def test_uploads_and_scores(spark, photo_dir, tmp_path):
    uploads = images.read_uploads(spark, photo_dir)
    errors = {r.path.rpartition("/")[2]: r.error for r in uploads.select("path", "error").collect()}
    assert "empty" in errors["empty.png"] and "neither" in errors["cat.gif"] and "corrupted" in errors["broken.png"] and errors["p0.png"] is None
    s = Settings(resize_to=(48, 48))
    table, _ = features.feature_table(named(spark, photo_dir), s)
    two = table.withColumn("class", F.when(F.col("id") == "p0", "A").otherwise("E"))
    model = fit_model("random_forest", FOREST, two, features.feature_names(s), 1)
    save_artifact(model, s, str(tmp_path / "model"), {"a": 1}, {"date": "today"})
    back = load_artifact(spark, str(tmp_path / "model"))
    assert back.model.classes == ["A", "E"] and back.model.columns == model.columns and back.settings.resize_to == (48, 48) and back.params == {"a": 1}
    graded = {r.path.rpartition("/")[2]: r for r in score(uploads, back).collect()}
    assert graded["p0.png"].grade == "A" and graded["p1.png"].grade == "E" and graded["p0.png"].description
    for bad in ("blank.png", "broken.png", "cat.gif", "empty.png"):
        assert graded[bad].grade is None and graded[bad].error
    with pytest.raises(FileNotFoundError):
        load_artifact(spark, str(tmp_path / "none"))


def test_mask_pictures(spark, photo_dir, tmp_path):
    found = images.write_masks(named(spark, photo_dir), str(tmp_path / "m"), Settings(), preview=5).collect()
    assert {r.id for r in found if r.mask_fraction} == {"p0", "p1"}
    held = {r.id: r for r in spark.read.parquet(str(tmp_path / "m")).collect()}
    crop, outline = (images.unpng(bytes(x)) for x in (held["p0"].crop, held["p0"].outline))
    assert crop.any() and (outline == (255, 0, 0)).all(axis=-1).any() and set(held) == {r.id for r in found}
    sheet = images.unpng((tmp_path / "m_preview.png").read_bytes())
    assert sheet.shape == (120, 960, 3) and (sheet[:, 480:] == 255).all() and (sheet[:, :480] < 255).any()


def test_missing_photos_are_named(spark, photo_dir):
    rows = spark.createDataFrame([("p0", "p0.png"), ("x", "x.png"), ("y", "y.png")], "id string, path string")
    found = images.with_images(rows, images.read_images(spark, photo_dir), photo_dir)
    with pytest.raises(FileNotFoundError, match="2 photos have no file: x.png, y.png"):
        images.require_images(found)
    assert images.require_images(found.filter("id = 'p0'")).count() == 1


def test_stream_of_events(spark, small):
    n = learning.QUERIES["stream_score"](spark, small).agg(F.sum("n")).first()[0]
    assert n == spark.read.parquet(f"{small}/events.parquet").count()


def test_photos_as_a_stream(spark, photo_dir, tmp_path):
    from sievework.streaming.score import score_stream

    s = Settings(resize_to=(48, 48))
    table, _ = features.feature_table(named(spark, photo_dir), s)
    two = table.withColumn("class", F.when(F.col("id") == "p0", "A").otherwise("E"))
    model = fit_model("random_forest", FOREST, two, features.feature_names(s), 1)
    save_artifact(model, s, str(tmp_path / "model"))
    for _ in range(2):  # the second run finds nothing new
        score_stream(spark, photo_dir, load_artifact(spark, str(tmp_path / "model")), str(tmp_path / "out"), str(tmp_path / "checkpoint"))
    got = {r.path.rpartition("/")[2]: r for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got["p0.png"].grade == "A" and got["p1.png"].grade == "E" and got["cat.gif"].error and got["broken.png"].error and len(got) == 5
    assert spark.read.parquet(str(tmp_path / "out")).count() == 5


def test_boosted_trees_fit_and_predict_every_class(spark, small):
    rows = learning.vector_table(spark, small, augmented=False)
    want = {r["class"]: r["count"] for r in rows.groupBy("class").count().collect()}
    got = {r["class"]: r.n for r in learning.boosted_trees(spark, small).groupBy("class").agg(F.sum("n").alias("n")).collect()}
    assert got == want and len(want) > 3
