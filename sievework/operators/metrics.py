"""Classification metrics and the fixed pass marks."""

from __future__ import annotations

import math
from collections import Counter

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..schema import BASELINE, ENSEMBLES, LABEL, MOISTURE_ORDER

PREDICTED = "predicted"


def moisture_rank(label: Column | str) -> Column:
    """A class's place in the order of moisture; null for other values."""
    return F.array_position(F.array(*map(F.lit, MOISTURE_ORDER)), label if isinstance(label, Column) else F.col(label))


def confusion_cells(preds: DataFrame, part: list[str] = [], label: str = LABEL, predicted: str = PREDICTED) -> DataFrame:  # noqa: B006
    """part, true, predicted, n: every pair of labels that are true or predicted somewhere in the part.

    Counts first: all that follows is as small as the square of the number of classes."""
    counts = preds.groupBy(*part, F.col(label).alias("true"), F.col(predicted).alias("pred")).agg(F.count("*").alias("n"))
    labels = counts.select(*part, F.explode(F.array("true", "pred")).alias("l")).distinct()
    pairs = labels.alias("a").join(labels.alias("b"), _same(part, "a", "b")).select(*[F.col(f"a.{c}") for c in part], F.col("a.l").alias("true"), F.col("b.l").alias("pred"))
    on = [*part, "true", "pred"]
    return pairs.join(counts, on, "left").select(*on, F.coalesce("n", F.lit(0).cast("long")).alias("n"))


def _same(part: list[str], a: str, b: str) -> Column:
    on = F.lit(True)
    for c in part:
        on &= F.col(f"{a}.{c}").eqNullSafe(F.col(f"{b}.{c}"))
    return on


def class_metrics(preds: DataFrame, part: list[str] = [], label: str = LABEL, predicted: str = PREDICTED) -> DataFrame:  # noqa: B006
    """part, class, tp, support, called, precision, recall, f1 for each true or predicted class; 0
    where a share has no denominator."""
    counts = preds.groupBy(*part, F.col(label).alias("true"), F.col(predicted).alias("pred")).agg(F.count("*").alias("n"))
    sides = F.explode(F.array(F.struct(F.col("true").alias("class"), F.col("n").alias("support"), F.lit(0).cast("long").alias("called")), F.struct(F.col("pred").alias("class"), F.lit(0).cast("long").alias("support"), F.col("n").alias("called"))))
    each = counts.select(*part, sides.alias("s"), F.when(F.col("true") == F.col("pred"), F.col("n")).otherwise(0).alias("hit"))
    summed = each.groupBy(*part, F.col("s.class").alias("class")).agg(F.sum("s.support").alias("support"), F.sum("s.called").alias("called"), (F.sum("hit") / 2).cast("long").alias("tp"))
    share = lambda a, b: F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))
    return summed.select(*part, "class", "tp", "support", "called", share(F.col("tp"), F.col("called")).alias("precision"), share(F.col("tp"), F.col("support")).alias("recall"), share(2 * F.col("tp"), F.col("support") + F.col("called")).alias("f1"))


def accuracy(preds: DataFrame, part: list[str] = [], label: str = LABEL, predicted: str = PREDICTED) -> DataFrame:  # noqa: B006
    return preds.groupBy(*part).agg(F.avg((F.col(label) == F.col(predicted)).cast("double")).alias("accuracy"))


def macro_f1(preds: DataFrame, part: list[str] = [], label: str = LABEL, predicted: str = PREDICTED) -> DataFrame:  # noqa: B006
    """part, macro_f1: the plain mean of all classes' F1, common or rare."""
    return class_metrics(preds, part, label, predicted).groupBy(*part).agg(F.avg("f1").alias("macro_f1"))


def macro_f1_value(preds: DataFrame, label: str = LABEL, predicted: str = PREDICTED) -> float:
    """macro_f1 of all rows as a number: one pass counts pairs of labels, at most the square of the
    number of classes; a table without rows is an error."""
    support, called, hit = Counter(), Counter(), Counter()
    for r in preds.groupBy(F.col(label).alias("true"), F.col(predicted).alias("pred")).agg(F.count("*").alias("n")).collect():
        support[r.true] += r.n
        called[r.pred] += r.n
        hit[r.true] += r.n if r.true is not None and r.true == r.pred else 0
    classes = support.keys() | called.keys()
    if not classes:
        raise ValueError("nothing is predicted")
    return math.fsum(2 * hit[c] / (support[c] + called[c]) for c in classes) / len(classes)


def per_fold_class_metrics(preds: DataFrame, part: list[str] = ["fold"], label: str = LABEL, predicted: str = PREDICTED) -> DataFrame:  # noqa: B006
    """Precision and recall of the classes that a fold's validation rows have."""
    return class_metrics(preds, part, label, predicted).filter("support > 0").select(*part, "class", "precision", "recall")


def score_summary(scores: DataFrame, part: list[str] = ["model"]) -> DataFrame:  # noqa: B006
    """Mean and sample standard deviation of macro F1; one score has no deviation."""
    return scores.groupBy(*part).agg(F.avg("macro_f1").alias("mean"), F.stddev_samp("macro_f1").alias("sd"))


def best_model(scores: DataFrame, candidates: tuple[str, ...] = ENSEMBLES) -> DataFrame:
    """The candidate with the highest mean score, the first listed on ties; empty if there is none."""
    place = F.array_position(F.array(*map(F.lit, candidates)), F.col("model"))
    means = scores.filter(F.col("model").isin(*candidates)).groupBy("model").agg(F.avg("macro_f1").alias("mean"))
    return means.groupBy().agg(F.max_by("model", F.struct("mean", -place)).alias("selected"), F.max("mean").alias("mean")).filter("selected is not null")


def select_model(scores: DataFrame) -> str:
    found = best_model(scores).first()
    if found is None:
        raise ValueError(f"no scores of a model that can be deployed; those are {', '.join(ENSEMBLES)}")
    return found.selected


def pass_marks(preds: DataFrame, scores: DataFrame, selected: str, marks: dict, label: str = LABEL, predicted: str = PREDICTED) -> DataFrame:
    """check, value (rounded half to even), target, passed (by the unrounded value), detail."""
    own = scores.filter(F.col("model") == selected).agg(F.avg("macro_f1").alias("mean"), F.coalesce(F.stddev_samp("macro_f1"), F.lit(0.0)).alias("sd"), F.count("*").alias("n"))
    classes = per_fold_class_metrics(preds.filter(F.col("model") == selected), ["fold"], label, predicted).groupBy("class").agg(F.avg("precision").alias("precision"), F.avg("recall").alias("recall"))
    row = lambda df, check, value, target, passed, detail: df.select(F.lit(check).alias("check"), F.bround(value, 4).alias("value"), target.cast("double").alias("target"), F.coalesce(passed, F.lit(False)).alias("passed"), detail.cast("string").alias("detail"))
    worst = classes.groupBy().agg(F.min(F.struct("recall", "class")).alias("w"))
    focus = classes.groupBy().agg(F.max(F.when(F.col("class") == marks["precision_class"], F.col("precision"))).alias("p"))
    out = row(own, "macro_f1", F.col("mean"), F.lit(marks["macro_f1"]), F.col("mean") >= marks["macro_f1"], F.lit(f"stretch {marks.get('macro_f1_stretch')}"))
    out = out.unionByName(row(worst, "min_class_recall", F.col("w.recall"), F.lit(marks["min_class_recall"]), F.col("w.recall") >= marks["min_class_recall"], F.col("w.class")))
    out = out.unionByName(row(focus, f"class_{marks['precision_class']}_precision", F.coalesce("p", F.lit(float("nan"))), F.lit(marks["class_precision"]), F.coalesce("p", F.lit(-1.0)) >= marks["class_precision"], F.lit(marks["precision_class"])))
    base = scores.filter(F.col("model") == BASELINE).agg(F.avg("macro_f1").alias("base")).filter("base is not null")
    gap = own.join(F.broadcast(base))  # one row each
    return out.unionByName(row(gap, "beats_baseline", F.col("mean") - F.col("base"), F.when(F.col("n") > 1, F.col("sd")).otherwise(F.lit(0.0)), F.col("mean") - F.col("base") > F.when(F.col("n") > 1, F.col("sd")).otherwise(F.lit(0.0)), F.lit("more than one standard deviation of the folds")))


def all_passed(checks: DataFrame) -> DataFrame:
    return checks.agg(F.every("passed").alias("all_passed"))


def ordered_matrix(cells: DataFrame) -> tuple[list[str], list[list[int]]]:
    """(labels by moisture, counts by true and predicted label) from confusion_cells."""
    rows = cells.withColumn("r", moisture_rank("true")).withColumn("c", moisture_rank("pred")).filter("r > 0 and c > 0").orderBy("r", "c").collect()
    labels = list(dict.fromkeys(r.true for r in rows))
    found = {(r.true, r.pred): r.n for r in rows}
    return labels, [[found[t, p] for p in labels] for t in labels]


def class_weights(df: DataFrame, label: str = LABEL) -> DataFrame:
    """Adds weight n / (k * n_c), by which every class has the same total."""
    counts = df.groupBy(F.col(label).alias("_l")).agg(F.count("*").alias("_n"))
    every = W.partitionBy()  # one row a class
    weights = counts.select("_l", (F.sum("_n").over(every) / (F.count("*").over(every) * F.col("_n"))).alias("weight"))
    return df.join(F.broadcast(weights), F.col(label).eqNullSafe(F.col("_l"))).drop("_l")


def family_shares(contributions: DataFrame, part: list[str]) -> DataFrame:
    """part, family, share: each family's part of all absolute contributions; all nought stays nought."""
    every = W.partitionBy(*part) if part else W.partitionBy()
    return contributions.withColumn("share", F.coalesce(F.try_divide(F.abs("value"), F.sum(F.abs("value")).over(every)), F.lit(0.0)))
