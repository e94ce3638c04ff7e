"""Queries that go through files and settings: what is written is read back. With their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.scalar import family_of
from ..operators import metrics
from ..sources.manifest import exclude, feature_columns, load_exclusions, load_manifest, read_table, write_table
from ..sources.settings import from_mapping
from . import training
from .learning import _shared
from .tabular import PREDICTED, photos, predictions, table

QUERIES: dict = {}
ORACLES: dict[str, str] = {}
DIGITS = tuple("0123456789")


def query(name: str, sql: str):
    def keep(f):
        QUERIES[name], ORACLES[name] = f, sql
        return f

    return keep


@query("photo_list_csv", "SELECT lpad(vec_id::VARCHAR, 8, '0') AS id, label || '-' || ((row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1) // 4) AS batch_id, label::VARCHAR AS class, 'photos/' || vec_id || '.jpg' AS path FROM embeddings")
def photo_list_csv(spark, d):
    """A photo list with the other name of its path column; ids keep their zeros."""
    path = f"{_shared(spark)}/photos.csv"
    write_table(photos(spark, d).select(F.lpad(F.col("id").cast("string"), 8, "0").alias("id"), "batch_id", "class", F.concat(F.lit("photos/"), "id", F.lit(".jpg")).alias("Photo photo")), path, csv=True)
    return load_manifest(spark, path, DIGITS).select("id", "batch_id", "class", "path")


@query("exclusion_list_csv", "SELECT lang, count(*) AS n FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1) GROUP BY 1")
def exclusion_list_csv(spark, d):
    """Documents left by a list that is read from a file; a list that is not there leaves all."""
    path = f"{_shared(spark)}/exclusions.csv"
    write_table(table(spark, d, "labels").filter("toxic = 1").select(F.col("doc_id").alias("id")), path, csv=True)
    docs = table(spark, d, "documents").withColumn("id", F.col("doc_id").cast("string"))
    kept, _ = exclude(docs, load_exclusions(spark, path))
    return exclude(kept, load_exclusions(spark, f"{path}-none"))[0].groupBy("lang").agg(F.count("*").alias("n"))


@query("feature_table_csv", "SELECT lpad(vec_id::VARCHAR, 8, '0') AS id, label::VARCHAR AS class, 3 AS columns, embedding[1]::DOUBLE + embedding[2]::DOUBLE + embedding[3]::DOUBLE AS total FROM embeddings")
def feature_table_csv(spark, d):
    """A feature table as CSV: what is about the photo stays text, the features are numbers."""
    path = f"{_shared(spark)}/features.csv"
    v = table(spark, d, "embeddings").select(F.lpad(F.col("vec_id").cast("string"), 8, "0").alias("id"), F.col("label").alias("class"), *[F.col("embedding")[k].cast("double").alias(f"glcm_{k}") for k in range(3)])
    write_table(v, path, csv=True)
    back = read_table(spark, path)
    columns = feature_columns(back)
    total = sum((F.col(c) for c in columns[1:]), F.col(columns[0]))
    return back.select("id", "class", F.lit(len(columns)).alias("columns"), total.alias("total"))


GIVEN = {"cleaning": {"zscore_threshold": 2.5}, "splitting": {"n_splits": 4}, "features": {"glcm": {"distances": [1, 5]}}, "tuning": None}


@query("settings_values", "SELECT 'zscore' AS name, '2.5' AS value UNION ALL SELECT 'iqr', '1.5' UNION ALL SELECT 'n_splits', '4' UNION ALL SELECT 'inner_n_splits', '3' UNION ALL SELECT 'inner', '3' UNION ALL SELECT 'glcm_distances', '(1, 5)' UNION ALL SELECT 'n_trials', '75'")
def settings_values(spark, d):
    """Settings from a nested mapping, with the defaults of what it lacks, and those of inner folds."""
    s = from_mapping(GIVEN)
    held = {**{name: getattr(s, name) for name in ("zscore", "iqr", "n_splits", "inner_n_splits", "glcm_distances", "n_trials")}, "inner": s.inner().n_splits}
    return spark.createDataFrame([(k, str(v)) for k, v in held.items()], "name string, value string")


@query("family_columns", "SELECT CASE i % 3 WHEN 0 THEN 'texture' WHEN 1 THEN 'color' ELSE 'edge' END AS family, count(*) AS n FROM range(64) t(i) GROUP BY 1")
def family_columns(spark, d):
    """The columns of a feature table that each family has, as ablation takes them."""
    from .learning import vector_table

    columns = feature_columns(vector_table(spark, d))
    return spark.createDataFrame([(family_of(c),) for c in columns], "family string").groupBy("family").agg(F.count("*").alias("n"))


@query("ablation_report", PREDICTED + """, named AS (SELECT CASE model WHEN 'random_forest' THEN 'combined' WHEN 'lightgbm' THEN 'color' ELSE 'texture' END AS features, macro_f1 FROM sc),
means AS (SELECT features, avg(macro_f1) AS mean FROM named GROUP BY 1), best AS (SELECT features, mean FROM means WHERE features <> 'combined' ORDER BY mean DESC, features LIMIT 1)
SELECT 'm' AS model, best.features AS best_single_family, round(best.mean, 9) AS best_mean, round(means.mean, 9) AS combined, means.mean >= best.mean AS combined_not_lower FROM best, means WHERE means.features = 'combined'""")
def ablation_report(spark, d):
    """The report on families alone and together, with three predictors in their place."""
    scores = metrics.macro_f1(predictions(spark, d), ["model", "fold"])
    features = F.when(F.col("model") == "random_forest", "combined").when(F.col("model") == "lightgbm", "color").otherwise("texture")
    report = training.ablation_report(scores.select(F.lit("m").alias("model"), features.alias("features"), "fold", "macro_f1"))
    return report.select("model", "best_single_family", F.round("best_mean", 9).alias("best_mean"), F.round("combined", 9).alias("combined"), "combined_not_lower")
