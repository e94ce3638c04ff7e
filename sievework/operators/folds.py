"""Grouped, stratified folds, and what a fold trains and validates on."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..schema import AUGMENT, BATCH, ID, LABEL, ORIGINAL, Settings
from .ranking import seeded, shuffled_rank
from .sampling import class_multipliers, training_rows


def group_folds(df: DataFrame, n_splits: int, group: str = BATCH, label: str = LABEL, seed: int = 42) -> DataFrame:
    """(group, label, fold): every group in one fold, each class dealt evenly.

    A group counts for its most frequent class (the first in order on ties). Groups are shuffled
    within the class and dealt in turn; a class goes on where the one before it stopped, so fold
    sizes differ by one group at most."""
    if missing := [c for c in (group, label) if c not in df.columns]:
        raise ValueError(f"columns missing: {', '.join(missing)}")
    votes = df.groupBy(group, label).agg(F.count("*").alias("n"))
    groups = votes.groupBy(group).agg(F.min_by(label, F.struct(-F.col("n"), F.col(label))).alias(label))
    if (found := groups.count()) < n_splits:
        raise ValueError(f"{n_splits} folds need as many groups; there are {found}")
    before = W.orderBy(label).rowsBetween(W.unboundedPreceding, -1)  # one row a class
    starts = groups.groupBy(label).agg(F.count("*").alias("n")).select(F.col(label).alias("_l"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("_start"))
    ranked = shuffled_rank(groups, [label], seeded(seed, group), [group])
    dealt = ranked.join(F.broadcast(starts), F.col(label).eqNullSafe(F.col("_l")))
    return dealt.select(group, label, F.pmod(F.col("rank") - 1 + F.col("_start"), F.lit(n_splits)).cast("int").alias("fold"))


def with_folds(table: DataFrame, settings: Settings, group: str = BATCH, label: str = LABEL) -> DataFrame:
    """The table with each row's validation fold; folds come from originals alone."""
    originals = table.filter(F.col(AUGMENT) == ORIGINAL) if AUGMENT in table.columns else table
    return table.join(group_folds(originals, settings.n_splits, group, label, settings.seed).select(group, "fold"), group)


def train_rows(folded: DataFrame, settings: Settings, key: str = ID, label: str = LABEL) -> DataFrame:
    """For every fold k, in column train_fold, the rows it trains on: originals of all other folds
    and seeded copies by its own class counts."""
    parts = folded.withColumn("train_fold", F.explode(F.sequence(F.lit(0), F.lit(settings.n_splits - 1)))).filter("fold <> train_fold")
    multipliers = class_multipliers(parts.filter(F.col(AUGMENT) == ORIGINAL), ["train_fold"], settings.base_copies, settings.max_copies, label)
    return training_rows(parts, ["train_fold"], multipliers, F.lit(settings.seed) + F.col("train_fold"), key, label)


def validation_rows(folded: DataFrame) -> DataFrame:
    """Originals only; fold says where they are validated."""
    return folded.filter(F.col(AUGMENT) == ORIGINAL)


def full_training_rows(table: DataFrame, settings: Settings, key: str = ID, label: str = LABEL) -> DataFrame:
    """All originals and their copies, by the counts of the whole table."""
    multipliers = class_multipliers(table.filter(F.col(AUGMENT) == ORIGINAL), [], settings.base_copies, settings.max_copies, label)
    return training_rows(table, [], multipliers, settings.seed, key, label)
