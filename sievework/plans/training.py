"""Nested cross-validation, the final fit, ablation by family, and what the background gives away."""

from __future__ import annotations

import functools
import itertools
from collections import defaultdict
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, replace
from typing import Any

from pyspark import StorageLevel
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import family_of
from ..operators.folds import full_training_rows, group_folds, train_rows, validation_rows, with_folds
from ..operators.metrics import PREDICTED, accuracy, macro_f1_value
from ..operators.models import SPACES, VECTOR, Fitted, Search, class_counts, fit_model, fit_vectors
from ..schema import AUGMENT, BASELINE, BATCH, ENSEMBLES, FAMILIES, ID, LABEL, META, ORIGINAL, Settings
from ..sources.manifest import feature_columns
from ..sources.scratch import Scratch, collect

#: Fits that run at the same time.
AT_ONCE = 4
#: A column that holds the features as they came.
PACKED = "_packed"


def packed(table: DataFrame, columns: list[str]) -> DataFrame:
    """What folds need, and the features in one column: plans stay narrow, however many there are."""
    return table.select(ID, BATCH, LABEL, AUGMENT, F.array(*[F.col(f"`{c}`").cast("double") for c in columns]).alias(PACKED))


def unpacked(rows: DataFrame, columns: list[str], sets: dict[str, list[str]]) -> DataFrame:
    """Packed rows of these columns with a vector for fits a set of them; a null or NaN in one is an error."""
    at = {c: i for i, c in enumerate(columns)}

    def vector(name: str, own: list[str]) -> Column:
        part = F.col(PACKED) if own == columns else F.array(*[F.get(PACKED, F.lit(at[c])) for c in own])
        whole = F.when(F.exists(part, lambda v: v.isNull() | F.isnan(v)), F.raise_error(F.lit("a feature is null or NaN"))).otherwise(part)
        return array_to_vector(whole).alias(name, metadata={"ml_attr": {"num_attrs": len(own)}})

    return rows.select(*[c for c in rows.columns if c != PACKED], *[vector(name, own) for name, own in sets.items()])


@dataclass(frozen=True)
class Folds:
    """Training rows by train_fold, validation originals by fold, and each train_fold's rows by class;
    vector is the column of features that fits read."""

    train: DataFrame
    val: DataFrame
    counts: dict[int, dict[str | None, int]]
    vector: str = VECTOR

    def fit(self, name: str, params: dict[str, Any], k: int, seed: int) -> Fitted:
        return fit_vectors(name, params, self.train.filter(F.col("train_fold") == k), seed, self.counts[k], self.vector)

    def predict(self, model: Fitted, k: int) -> DataFrame:
        return model.predict(self.val.filter(F.col("fold") == k))


def make_folds(folded: DataFrame, columns: list[str], settings: Settings, scratch: Scratch, sets: dict[str, list[str]] | None = None) -> Folds:
    """Of packed rows of these columns with folds, written once: every fit reads them. sets: the
    columns of each vector, by its name; else there is one of all."""
    sets = sets or {VECTOR: columns}
    train = scratch.keep(unpacked(train_rows(folded, settings), columns, sets).select("train_fold", ID, AUGMENT, LABEL, *sets), "train_fold", [ID, AUGMENT])
    val = scratch.keep(unpacked(validation_rows(folded), columns, sets).select("fold", ID, BATCH, LABEL, *sets), "fold", [ID])
    counts: dict[int, dict[str | None, int]] = defaultdict(dict)
    for r in class_counts(train, ["train_fold"]).collect():  # a row a fold and class
        counts[r.train_fold][r.label] = r.n
    return Folds(train, val, counts)


def tune_model(name: str, table: DataFrame, settings: Settings, n_trials: int, seed: int, n_splits: int | None = None, space: dict[str, Any] | None = None, folds: Folds | None = None) -> Search:
    """Seeks parameters by mean macro F1 over grouped inner folds of table, which are made once; folds
    are those, if they are made already."""
    inner = settings.inner(n_splits)
    search = Search(space or SPACES[name], seed)
    with Scratch(table.sparkSession) as scratch, ThreadPoolExecutor(min(AT_ONCE, inner.n_splits)) as pool:
        own = folds
        if own is None:
            columns = feature_columns(table)
            own = make_folds(scratch.keep(with_folds(packed(table, columns), inner)), columns, inner, scratch)
        for _ in range(n_trials):
            params = search.suggest()
            scores = list(pool.map(lambda k, p=params: macro_f1_value(own.predict(own.fit(name, p, k, seed), k)), range(inner.n_splits)))
            search.tell(params, sum(scores) / len(scores))
            collect(table.sparkSession)  # else what trials leave fills the driver
    return search


@dataclass(frozen=True)
class CVResult:
    """scores: model, fold, macro_f1; params: model, fold, params; predictions: out of fold."""

    scores: DataFrame
    params: DataFrame
    predictions: DataFrame


@dataclass(frozen=True)
class Outer:
    """Of one model on one set of features in one outer fold; rows are the validated originals, if kept."""

    features: str
    model: str
    fold: int
    macro_f1: float
    params: dict[str, Any]
    rows: DataFrame | None


def validate(table: DataFrame, sets: dict[str, list[str]], settings: Settings, names: tuple[str, ...], n_trials: int, spaces: dict[str, dict[str, Any]] | None = None, results: Scratch | None = None) -> list[Outer]:
    """For every outer fold, set of features and model: tune on the training photos alone, fit, and
    predict the validation originals, kept in results.

    Folds do not depend on features, so all sets and models share them. Sets and models are searched
    in turn, as more at a time take more of the driver's memory."""
    spark, inner, found = table.sparkSession, settings.inner(), []
    columns = list(dict.fromkeys(c for own in sets.values() for c in own))
    vectors = {f"{VECTOR}_{i}": own for i, own in enumerate(sets.values())}
    with Scratch(spark) as scratch:
        folded = scratch.keep(with_folds(packed(table, columns), settings))
        outer = make_folds(folded, columns, settings, scratch, vectors)
        for k in range(settings.n_splits):
            photos = folded.filter(F.col("fold") != k).drop("fold")
            with Scratch(spark) as part:
                folds = make_folds(part.keep(with_folds(photos, inner)), columns, inner, part, vectors)
                for (features, vector), name in itertools.product(zip(sets, vectors, strict=True), names):
                    search = tune_model(name, photos, settings, n_trials, settings.seed + k, space=(spaces or {}).get(name), folds=replace(folds, vector=vector))
                    best, _ = search.best
                    own = replace(outer, vector=vector)
                    rows = own.predict(own.fit(name, best, k, settings.seed + k), k).select(ID, BATCH, LABEL, F.lit(k).alias("fold"), F.lit(name).alias("model"), PREDICTED)
                    rows = results.keep(rows) if results else rows
                    found.append(Outer(features, name, k, macro_f1_value(rows), best, rows if results else None))
    return found


def cross_validate(table: DataFrame, settings: Settings, names: tuple[str, ...], n_trials: int, spaces: dict[str, dict[str, Any]] | None = None) -> CVResult:
    """validate on all features."""
    spark = table.sparkSession
    found = validate(table, {"combined": feature_columns(table)}, settings, names, n_trials, spaces, Scratch(spark))
    scores = [(x.model, x.fold, x.macro_f1) for x in found]
    params = [(x.model, x.fold, {p: str(v) for p, v in x.params.items()}) for x in found]
    predictions = functools.reduce(DataFrame.unionByName, (x.rows for x in found))
    return CVResult(spark.createDataFrame(scores, "model string, fold int, macro_f1 double"), spark.createDataFrame(params, "model string, fold int, params map<string,string>"), predictions)


def fit_final(table: DataFrame, settings: Settings, name: str, n_trials: int, space: dict[str, Any] | None = None) -> tuple[Fitted, dict[str, Any]]:
    """Tuned on all rows with the outer number of folds, fitted on all originals and copies."""
    if name not in ENSEMBLES:
        raise ValueError(f"{name} is not for deployment; those are {', '.join(ENSEMBLES)}")
    search = tune_model(name, table, settings, n_trials, settings.seed, settings.n_splits, space)
    best, _ = search.best
    return fit_model(name, best, full_training_rows(table, settings), feature_columns(table), settings.seed), best


def ablation(table: DataFrame, combined: DataFrame | None, settings: Settings, names: tuple[str, ...], n_trials: int, spaces: dict | None = None) -> tuple[DataFrame, DataFrame]:
    """(model, features, fold, macro_f1 of each family alone and of all; the report of best families).

    combined: the scores of all features; None has them made here, on the folds of the families."""
    spark, every = table.sparkSession, feature_columns(table)
    sets = {family: own for family in dict.fromkeys(FAMILIES.values()) if (own := [c for c in every if family_of(c) == family])}
    if combined is None:
        sets = {"combined": every} | sets
    else:
        combined = combined.filter(F.col("model").isin(*names)).select("model", F.lit("combined").alias("features"), "fold", "macro_f1")
        if missing := sorted(set(names) - {r.model for r in combined.select("model").distinct().collect()}):
            raise ValueError(f"no combined scores of {', '.join(missing)}")
    found = validate(table, sets, settings, names, n_trials, spaces) if sets else []
    rows = spark.createDataFrame([(x.model, x.features, x.fold, x.macro_f1) for x in found], "model string, features string, fold int, macro_f1 double")
    rows = rows if combined is None else combined.unionByName(rows)
    return rows, ablation_report(rows)


def ablation_report(rows: DataFrame) -> DataFrame:
    """model, best_single_family (the first by name on ties), its mean, and whether all together are no lower."""
    means = rows.groupBy("model", "features").agg(F.avg("macro_f1").alias("mean"))
    single = means.filter("features <> 'combined'").groupBy("model").agg(F.min(F.struct(-F.col("mean"), "features")).alias("b"))
    both = means.filter("features = 'combined'").select("model", F.col("mean").alias("combined"))
    return both.join(single, "model").select("model", F.col("b.features").alias("best_single_family"), (-F.col("b.col1")).alias("best_mean"), "combined", (F.col("combined") >= -F.col("b.col1")).alias("combined_not_lower"))


def paper_accuracy(table: DataFrame, settings: Settings, prefix: str = "paper_") -> DataFrame:
    """mean_accuracy, chance, n_classes, n_photos, leak: grouped accuracy of a balanced logistic
    regression that sees the background only."""
    columns = [c for c in table.columns if c.startswith(prefix)]
    folded = table.join(group_folds(table, settings.n_splits, seed=settings.seed).select(BATCH, "fold"), BATCH).persist(StorageLevel.MEMORY_AND_DISK)

    def one(k: int) -> DataFrame:
        model = fit_model(BASELINE, {"C": 1.0}, folded.filter(F.col("fold") != k), columns, settings.seed)
        return accuracy(model.predict(folded.filter(F.col("fold") == k))).withColumn("fold", F.lit(k))

    with ThreadPoolExecutor(AT_ONCE) as pool:
        parts = list(pool.map(one, range(settings.n_splits)))
    scores = parts[0]
    for p in parts[1:]:
        scores = scores.unionByName(p)
    classes = table.agg(F.count_distinct(LABEL).alias("n_classes"), F.count("*").alias("n_photos"))
    mean = scores.agg(F.avg("accuracy").alias("mean"))
    out = mean.join(F.broadcast(classes))  # one row each
    return out.select(F.bround("mean", 4).alias("mean_accuracy"), F.bround(1 / F.col("n_classes"), 4).alias("chance"), "n_classes", "n_photos", (F.col("mean") > settings.leak_accuracy).alias("leak"))


def originals(table: DataFrame) -> DataFrame:
    return table.filter(F.col(AUGMENT) == ORIGINAL)
