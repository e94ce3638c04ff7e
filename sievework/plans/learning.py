"""Queries that fit models, read images or run streams; none has SQL."""

from __future__ import annotations

import tempfile

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import explain, features
from ..operators.metrics import PREDICTED, accuracy, macro_f1
from ..operators.models import Range, fit_model
from ..schema import MODELS, TRANSFORMS, Settings
from ..sources.images import png, put, read_images
from . import training
from .tabular import photos

#: Trees small enough to fit in seconds, for tests; no query has them.
SMALL = {"random_forest": {"n_estimators": Range(3, 6), "max_depth": Range(2, 4), "min_samples_leaf": Range(1, 3), "max_features": ("sqrt",)}, "logistic_regression": {"C": Range(0.1, 10.0, True), "l1_ratio": (0.0,)}}
#: The published job: its folds, copies and trials; models and search spaces are the published ones too.
WHOLE = Settings()
FAMILY_OF = ("glcm_", "hsv_", "edge_")
DIMS = 64
QUERIES: dict = {}


def query(f):
    QUERIES[f.__name__] = f
    return f


def vector_table(spark: SparkSession, d: str, augmented: bool = True) -> DataFrame:
    """Photos with the values of their vectors as features of three families; copies are the same
    values, as a symmetry leaves most features alone."""
    v = spark.read.parquet(f"{d}/embeddings.parquet")
    named = [F.col("embedding")[i].cast("double").alias(f"{FAMILY_OF[i % 3]}{i}") for i in range(DIMS)]
    rows = photos(spark, d).join(v.select(F.col("vec_id").alias("id"), *named), "id").withColumn("id", F.col("id").cast("string"))
    return rows.withColumn("augment", F.explode(F.array(*map(F.lit, TRANSFORMS)))) if augmented else rows


@query
def nested_cv(spark, d):
    return training.cross_validate(vector_table(spark, d), WHOLE, MODELS, WHOLE.n_trials).scores


@query
def model_accuracy(spark, d):
    rows = vector_table(spark, d, augmented=False)
    columns = [c for c in rows.columns if c.startswith(FAMILY_OF)]
    forest = fit_model("random_forest", {"n_estimators": 5, "max_depth": 4}, rows, columns, 1)
    return accuracy(forest.predict(rows)).join(macro_f1(forest.predict(rows)))


@query
def boosted_trees(spark, d):
    rows = vector_table(spark, d, augmented=False)
    columns = [c for c in rows.columns if c.startswith(FAMILY_OF)]
    model = fit_model("xgboost", {"n_estimators": 2, "max_depth": 2, "learning_rate": 0.3}, rows, columns, 1)
    return model.predict(rows).groupBy("class", PREDICTED).agg(F.count("*").alias("n"))


@query
def lighting_leak(spark, d):
    v = spark.read.parquet(f"{d}/embeddings.parquet")
    named = [F.col("embedding")[i].cast("double").alias(f"paper_{i}") for i in range(DIMS)]
    rows = photos(spark, d).join(v.select(F.col("vec_id").alias("id"), *named), "id")
    return training.paper_accuracy(rows, Settings(n_splits=2))


@query
def ablation(spark, d):
    return training.ablation(vector_table(spark, d), None, WHOLE, MODELS, WHOLE.n_trials)[1]


@query
def shap_by_family(spark, d):
    rows = vector_table(spark, d, augmented=False)
    columns = [c for c in rows.columns if c.startswith(FAMILY_OF)]
    forest = fit_model("random_forest", {"n_estimators": 3, "max_depth": 3}, rows, columns, 1)
    return explain.importance_by_family(explain.shapley_values(forest, rows))


def _shared(spark: SparkSession) -> str:
    """A folder that the executors share; one of our own only where the session names none."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    return f"{named.rstrip('/')}/sievework-engine/{np.random.default_rng().integers(1 << 62)}" if named else tempfile.mkdtemp(prefix="sievework-")


def generated_photos(n: int = 3, size: tuple[int, int] = (96, 128)) -> list[tuple[str, bytes]]:
    """Two-tone objects on a gray ramp."""
    out = []
    for k in range(n):
        y, x = np.indices(size)
        image = np.repeat((110 + 50 * x / size[1])[..., None], 3, axis=-1)
        inside = (abs(y - size[0] / 2) < size[0] / 4) & (abs(x - size[1] / 2) < size[1] / 4)
        image[inside] = (70 + 50 * k, 45, 25)
        image[inside & (y > size[0] / 2)] = (235, 225, 205)
        image = np.clip(image + np.random.default_rng(k).normal(0, 2, image.shape), 0, 255).astype(np.uint8)
        out.append((f"p{k}", png(image)))
    return out


@query
def feature_table(spark, d):
    """Features of generated photos, through the image reader; no table holds photos."""
    folder = f"{_shared(spark)}/photos"
    for name, body in generated_photos():
        put(spark, f"{folder}/{name}.png", body)
    images = read_images(spark, folder)
    named = images.select(F.regexp_extract("origin", r"([^/]+)\.png$", 1).alias("id"), F.lit("b").alias("batch_id"), F.lit("A").alias("class"), "image")
    return features.feature_rows(named, Settings(resize_to=(48, 48)))


@query
def stream_score(spark, d):
    """All events, graded by a stream that runs to the end of its files."""
    from ..streaming.score import count_stream

    folder = _shared(spark)
    spark.read.parquet(f"{d}/events.parquet").write.mode("overwrite").parquet(f"{folder}/in")
    count_stream(spark, f"{folder}/in", f"{folder}/out", f"{folder}/checkpoint")
    return spark.read.parquet(f"{folder}/out").groupBy("event_type", "grade").agg(F.count("*").alias("n"))
