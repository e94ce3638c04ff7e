"""Shapley values of tree ensembles, and their sums by feature family."""

from __future__ import annotations

from collections.abc import Iterator
from math import factorial

import numpy as np
import pandas as pd
from pyspark.ml.classification import GBTClassificationModel, OneVsRestModel, RandomForestClassificationModel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import feature_family
from ..schema import ID
from .metrics import PREDICTED, family_shares
from .models import Fitted


#: Rows that go down the trees together.
ROWS = 512


class Tree:
    """A binary tree as arrays: feature (-1 at leaves), threshold, children, cover, value (n, classes)."""

    def __init__(self, root, leaf_value) -> None:
        self.feature, self.threshold, self.left, self.right, self.cover, self.value = [], [], [], [], [], []
        self._add(root, leaf_value)
        self.value = np.array(self.value, float)

    def _add(self, node, leaf_value) -> int:
        at = len(self.feature)
        leaf = node.numDescendants() == 0
        self.feature.append(-1 if leaf else node.split().featureIndex())
        self.threshold.append(0.0 if leaf else node.split().threshold())
        self.cover.append(float(node.impurityStats().count()))
        self.value.append(leaf_value(node))
        self.left.append(-1)
        self.right.append(-1)
        if not leaf:
            self.left[at] = self._add(node.leftChild(), leaf_value)
            self.right[at] = self._add(node.rightChild(), leaf_value)
        return at

    def shapley(self, x: np.ndarray) -> np.ndarray:
        """(rows, features, classes) of (rows, features): path-dependent Shapley values (Lundberg et al.,
        2018), all rows down the tree together.

        A leaf pays out to the features on its path alone; each stands with 1 (x follows the path) or
        0, or, left out, with the share of cover the path takes. Orders are summed by the number of
        features present, one polynomial a leaf and row."""
        out = np.zeros((*x.shape, self.value.shape[1]))
        stack: list[tuple[int, dict[int, tuple[np.ndarray, float]]]] = [(0, {})]
        while stack:
            node, path = stack.pop()
            f = self.feature[node]
            if f < 0:
                self._pay(out, path, self.value[node])
                continue
            goes_left = x[:, f] <= self.threshold[node]
            one, zero = path.get(f, (np.ones(len(x)), 1.0))
            for child, follows in ((self.left[node], goes_left), (self.right[node], ~goes_left)):
                share = self.cover[child] / self.cover[node] if self.cover[node] else 0.0
                stack.append((child, {**path, f: (one * follows, zero * share)}))
        return out

    @staticmethod
    def _pay(out: np.ndarray, path: dict[int, tuple[np.ndarray, float]], value: np.ndarray) -> None:
        m = len(path)
        weights = np.array([factorial(k) * factorial(m - 1 - k) / factorial(m) for k in range(m)])
        for f, (one, zero) in path.items():
            poly = np.zeros((len(out), m))  # by the number of other features present
            poly[:, 0] = 1.0
            for g, (o, z) in path.items():
                if g != f:
                    poly[:, 1:] = poly[:, 1:] * z + poly[:, :-1] * o[:, None]
                    poly[:, 0] *= z
            out[:, f] += ((one - zero) * (poly @ weights))[:, None] * value

    def mean(self) -> np.ndarray:
        """The value without any feature known."""
        def at(node: int) -> np.ndarray:
            if self.feature[node] < 0:
                return self.value[node]
            l, r = self.left[node], self.right[node]
            return (self.cover[l] * at(l) + self.cover[r] * at(r)) / max(self.cover[l] + self.cover[r], 1e-300)

        return at(0)

    def at(self, x: np.ndarray) -> np.ndarray:
        node = 0
        while self.feature[node] >= 0:
            node = self.left[node] if x[self.feature[node]] <= self.threshold[node] else self.right[node]
        return self.value[node]


def ensemble(model: Fitted) -> tuple[list[tuple[float, Tree]], int]:
    """(weighted trees, number of classes): probabilities of a forest, margins of boosted trees."""
    core = next(s for s in model.pipeline.stages if isinstance(s, (RandomForestClassificationModel, OneVsRestModel)))
    if isinstance(core, RandomForestClassificationModel):
        share = lambda node: (lambda s: s / max(s.sum(), 1e-300))(np.array(list(node.impurityStats().stats())))
        return [(1.0 / core.getNumTrees, Tree(t._call_java("rootNode"), share)) for t in core.trees], core.numClasses
    found = []
    for k, one in enumerate(core.models):
        assert isinstance(one, GBTClassificationModel)
        column = np.eye(len(core.models))[k]
        found += [(w, Tree(t._call_java("rootNode"), lambda node, c=column: node.prediction() * c)) for w, t in zip(one.treeWeights, one.trees, strict=True)]
    return found, len(core.models)


def shapley_values(model: Fitted, df: DataFrame, key: str = ID) -> DataFrame:
    """key, predicted, class_index, feature, value: a row for each feature and class. The trees, as
    large as the model, go to every task; rows are worked on where they are."""
    trees, n = ensemble(model)
    sent = df.sparkSession.sparkContext.broadcast(trees)
    columns = list(model.columns)

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for every in batches:
            for at in range(0, len(every), ROWS):
                batch = every.iloc[at : at + ROWS]
                x = batch[columns].to_numpy(float)
                total = sum(w * t.shapley(x) for w, t in sent.value)
                each = len(columns) * n
                yield pd.DataFrame({
                    key: np.repeat(batch[key].to_numpy(), each), PREDICTED: np.repeat(batch[PREDICTED].to_numpy(), each), "class_index": np.tile(np.arange(n), len(batch) * len(columns)),
                    "feature": np.tile(np.repeat(np.array(columns, object), n), len(batch)), "value": total.reshape(-1)})

    scored = model.predict(df).select(key, PREDICTED, *[F.col(f"`{c}`") for c in columns])
    return scored.mapInPandas(work, f"{key} {dict(scored.dtypes)[key]}, {PREDICTED} string, class_index int, feature string, value double")



def importance_by_family(values: DataFrame, family=None) -> DataFrame:
    """family, value: each feature's mean absolute value over rows and classes, summed by family."""
    per = values.groupBy("feature").agg(F.avg(F.abs("value")).alias("value"))
    return per.groupBy((feature_family(F.col("feature")) if family is None else family).alias("family")).agg(F.sum("value").alias("value"))


def explain_predictions(model: Fitted, df: DataFrame, key: str = ID, family=None) -> DataFrame:
    """key, predicted, family, value, share: signed sums toward each row's own class."""
    place = F.array_position(F.array(*map(F.lit, model.classes)), F.col(PREDICTED)) - 1
    own = shapley_values(model, df, key).filter(F.col("class_index") == place)
    sums = own.groupBy(key, PREDICTED, (feature_family(F.col("feature")) if family is None else family).alias("family")).agg(F.sum("value").alias("value"))
    return family_shares(sums, [key])
