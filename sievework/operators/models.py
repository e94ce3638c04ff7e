"""Classifiers: search spaces, fitting with balanced classes, and a seeded search over parameters."""

from __future__ import annotations

import math
import random
import warnings
from collections.abc import Callable
from dataclasses import dataclass
from typing import Any

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, LogisticRegression, OneVsRest, RandomForestClassifier
from pyspark.ml.feature import IndexToString, StandardScaler, StringIndexerModel, VectorAssembler
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..schema import BASELINE, LABEL, MODELS
from .metrics import PREDICTED


@dataclass(frozen=True)
class Range:
    """A number between two ends, on a log scale if said; whole if the ends are."""

    low: float
    high: float
    log: bool = False

    @property
    def whole(self) -> bool:
        return isinstance(self.low, int) and isinstance(self.high, int)

    def at(self, u: float) -> float | int:
        if self.log:
            return math.exp(math.log(self.low) + u * (math.log(self.high) - math.log(self.low)))
        if self.whole:
            return min(int(self.low) + int(u * (self.high - self.low + 1)), int(self.high))
        return self.low + u * (self.high - self.low)

    def of(self, value: float) -> float:
        if self.log:
            return (math.log(value) - math.log(self.low)) / (math.log(self.high) - math.log(self.low))
        return (value - self.low + (0.5 if self.whole else 0)) / (self.high - self.low + (1 if self.whole else 0))


# The published search spaces.
SPACES: dict[str, dict[str, Any]] = {
    "logistic_regression": {"C": Range(1e-3, 1e2, True), "l1_ratio": (0.0, 1.0)},
    "random_forest": {"n_estimators": Range(100, 500), "max_depth": Range(3, 20), "min_samples_leaf": Range(1, 10), "max_features": ("sqrt", "log2", None)},
    "xgboost": {"n_estimators": Range(100, 500), "max_depth": Range(3, 10), "learning_rate": Range(1e-3, 0.3, True), "min_child_weight": Range(1, 10), "subsample": Range(0.5, 1.0), "colsample_bytree": Range(0.5, 1.0), "reg_alpha": Range(1e-3, 10.0, True), "reg_lambda": Range(1e-3, 10.0, True)},
    "lightgbm": {"n_estimators": Range(100, 500), "num_leaves": Range(7, 127), "max_depth": Range(3, 12), "learning_rate": Range(1e-3, 0.3, True), "min_child_weight": Range(1e-3, 10.0, True), "min_child_samples": Range(5, 50), "subsample": Range(0.5, 1.0), "colsample_bytree": Range(0.5, 1.0), "reg_alpha": Range(1e-3, 10.0, True), "reg_lambda": Range(1e-3, 10.0, True)},
}
#: Parameters that boosted trees here have no counterpart for: recorded, not used.
UNUSED = {"xgboost": ("reg_alpha", "reg_lambda"), "lightgbm": ("num_leaves", "min_child_weight", "reg_alpha", "reg_lambda")}


def _logistic(p: dict, seed: int, n: int):
    # balanced weights sum to n, and the penalty here is of the mean loss
    return LogisticRegression(family="multinomial", maxIter=int(p.get("max_iter", 100)), regParam=1.0 / (float(p.get("C", 1.0)) * max(n, 1)), elasticNetParam=float(p.get("l1_ratio", 0.0)), standardization=False)


def _forest(p: dict, seed: int, n: int):
    return RandomForestClassifier(numTrees=int(p.get("n_estimators", 100)), maxDepth=int(p.get("max_depth", 5)), minInstancesPerNode=int(p.get("min_samples_leaf", 1)), featureSubsetStrategy={None: "all"}.get(p.get("max_features", "sqrt"), p.get("max_features", "sqrt")), seed=seed)


def _boosted(p: dict, seed: int, n: int):
    least = int(p.get("min_child_samples", p.get("min_child_weight", 1)))
    tree = GBTClassifier(maxIter=int(p.get("n_estimators", 100)), maxDepth=int(p.get("max_depth", 5)), stepSize=float(p.get("learning_rate", 0.1)), subsamplingRate=float(p.get("subsample", 1.0)), featureSubsetStrategy=str(float(p.get("colsample_bytree", 1.0))), minInstancesPerNode=max(1, least), seed=seed)
    return OneVsRest(classifier=tree, parallelism=4)


BUILD: dict[str, Callable] = {"logistic_regression": _logistic, "random_forest": _forest, "xgboost": _boosted, "lightgbm": _boosted}


@dataclass(frozen=True)
class Fitted:
    """A fitted pipeline with its model's name, classes and the columns it reads, in their order."""

    name: str
    pipeline: PipelineModel
    columns: tuple[str, ...]

    @property
    def classes(self) -> list[str]:
        return list(next(s for s in self.pipeline.stages if isinstance(s, IndexToString)).getLabels())

    def predict(self, df: DataFrame) -> DataFrame:
        """df with the predicted class; a missing column is an error."""
        if missing := [c for c in self.columns if c not in df.columns]:
            raise KeyError(f"columns missing: {', '.join(missing)}")
        keep = df.columns
        return self.pipeline.transform(df).select(*[F.col(f"`{c}`") for c in keep if c != PREDICTED], PREDICTED)


#: A column of assembled features.
VECTOR = "_raw"


def class_counts(df: DataFrame, part: list[str] = [], label: str = LABEL) -> DataFrame:  # noqa: B006
    """part, label (as a string), n: one row a class."""
    return df.groupBy(*part, F.col(label).cast("string").alias("label")).agg(F.count("*").alias("n"))


def fit_vectors(name: str, params: dict[str, Any], train: DataFrame, seed: int, counts: dict[str | None, int], vector: str = VECTOR, label: str = LABEL) -> Fitted:
    """As fit_model, on assembled features and with the number of train's rows of each class at hand."""
    if name not in BUILD:
        raise ValueError(f"no model {name}; there are {', '.join(MODELS)}")
    if ignored := [k for k in UNUSED.get(name, ()) if k in params]:
        warnings.warn(f"{name} does not use {', '.join(ignored)}", stacklevel=2)
    n = sum(counts.values())
    labels = sorted((c for c in counts if c is not None), key=lambda c: c.encode("utf-16-be"))  # as the indexer sorts
    if not labels:
        raise ValueError("no row has a class")
    weights = [n / (len(counts) * counts[c]) for c in labels]  # as metrics.class_weights
    indexer = StringIndexerModel.from_labels(labels, inputCol=label, outputCol="_label", handleInvalid="skip")
    rows = indexer.transform(train.select(vector, label)).withColumn("weight", F.array(*map(F.lit, weights))[F.col("_label").cast("int")])
    features = vector if name != BASELINE else "_features"
    scaler = [StandardScaler(inputCol=vector, outputCol=features, withMean=True, withStd=True)] if name == BASELINE else []
    estimator = BUILD[name](params, seed, n)
    for setter, value in (("setFeaturesCol", features), ("setLabelCol", "_label"), ("setPredictionCol", "_prediction"), ("setWeightCol", "weight")):
        getattr(estimator, setter)(value)
    if isinstance(estimator, OneVsRest):
        estimator.getClassifier().setFeaturesCol(features).setWeightCol("weight")
    letters = IndexToString(inputCol="_prediction", outputCol=PREDICTED, labels=labels)
    body = Pipeline(stages=[*scaler, estimator]).fit(rows)
    # the indexer only knows the classes: what is scored has no label
    return Fitted(name, PipelineModel([*body.stages, letters]), (vector,))


def fit_model(name: str, params: dict[str, Any], train: DataFrame, columns: list[str], seed: int, label: str = LABEL) -> Fitted:
    """Fits with class weights that give every class the same total."""
    vector = VECTOR if name == BASELINE else "_features"
    assembler = VectorAssembler(inputCols=columns, outputCol=vector, handleInvalid="error")
    rows = train.select(*[F.col(f"`{c}`") for c in columns], label)
    counts = {r.label: r.n for r in class_counts(rows, label=label).collect()} if name in BUILD else {}  # one row a class
    fitted = fit_vectors(name, params, assembler.transform(rows), seed, counts, vector, label)
    return Fitted(name, PipelineModel([assembler, *fitted.pipeline.stages]), tuple(columns))


class Search:
    """Seeded tree-structured Parzen estimation (Bergstra et al., 2011): after some random trials,
    candidates drawn near the better trials are ranked by how much likelier they are there than near
    the others."""

    def __init__(self, space: dict[str, Any], seed: int, warm_up: int = 10, candidates: int = 24, better: float = 0.25) -> None:
        self.space, self.rng, self.warm_up, self.candidates, self.better = space, random.Random(seed), warm_up, candidates, better
        self.trials: list[tuple[dict[str, Any], float]] = []

    def suggest(self) -> dict[str, Any]:
        good, bad = self._split()
        return {name: self._one(name, dim, good, bad) for name, dim in self.space.items()}

    def tell(self, params: dict[str, Any], score: float) -> None:
        self.trials.append((params, score))

    @property
    def best(self) -> tuple[dict[str, Any], float]:
        """The first of the best trials."""
        return max(self.trials, key=lambda t: t[1])

    def _split(self) -> tuple[list[dict], list[dict]]:
        if len(self.trials) < self.warm_up:
            return [], []
        ranked = [p for p, _ in sorted(self.trials, key=lambda t: -t[1])]
        k = max(1, math.ceil(self.better * math.sqrt(len(ranked))))
        return ranked[:k], ranked[k:]

    def _one(self, name: str, dim: Any, good: list[dict], bad: list[dict]) -> Any:
        if not isinstance(dim, Range):
            if not good:
                return self.rng.choice(dim)
            odds = [(1 + sum(p[name] == v for p in good)) / (len(good) + len(dim)) for v in dim]
            return self.rng.choices(dim, odds)[0]
        if not good:
            return dim.at(self.rng.random())
        width = max(0.05, 1 / (1 + len(good)))
        near, far = [dim.of(p[name]) for p in good], [dim.of(p[name]) for p in bad]
        drawn = [min(max(self.rng.gauss(self.rng.choice(near), width), 0.0), 1 - 1e-9) for _ in range(self.candidates)]
        density = lambda u, xs: (1 + sum(math.exp(-0.5 * ((u - x) / width) ** 2) / (width * 2.5066) for x in xs)) / (1 + len(xs))
        return dim.at(max(drawn, key=lambda u: density(u, near) / density(u, far)))


def suggest_params(name: str, search: Search) -> dict[str, Any]:
    if search.space is not SPACES[name]:
        raise ValueError(f"the search is not over the parameters of {name}")
    return search.suggest()
