"""Seeded trimming of classes and choice of training rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..schema import AUGMENT, BATCH, ID, LABEL, ORIGINAL, TRANSFORMS
from .ranking import seeded, shuffled_rank


def trimmed_batches(df: DataFrame, ratio: float, seed: int, batch: str = BATCH, label: str = LABEL) -> DataFrame:
    """(label, batch, dropped): classes keep at most floor(smallest / ratio) batches, chosen by seed."""
    batches = df.filter(F.col(batch).isNotNull()).select(label, batch).distinct()
    sizes = batches.groupBy(label).agg(F.count("*").alias("n"))
    cap = sizes.agg(F.floor(F.min("n") / F.lit(float(ratio)) + 1e-9).alias("cap"))  # one row
    ranked = shuffled_rank(batches, [label], seeded(seed, batch), [batch])
    return ranked.join(F.broadcast(cap)).select(label, batch, (F.col("rank") > F.col("cap")).alias("dropped"))


def balance(df: DataFrame, ratio: float, seed: int, batch: str = BATCH, label: str = LABEL) -> tuple[DataFrame, DataFrame]:
    """(rows kept, dropped label and batch): whole batches go, and with them all their rows."""
    dropped = trimmed_batches(df, ratio, seed, batch, label).filter("dropped").select(label, batch)
    return df.join(dropped.select(batch).distinct(), batch, "left_anti"), dropped


def copies(size: Column, largest: Column, base: int, most: int) -> Column:
    """Extra copies of each photo of a class, so that small classes catch up with the largest."""
    grown = F.bround(F.lit(base + 1) * largest / F.greatest(size, F.lit(1)), 0).cast("int") - 1
    return F.least(F.lit(min(most, len(TRANSFORMS) - 1)), F.greatest(F.lit(base), grown))


def class_multipliers(df: DataFrame, part: list[str], base: int, most: int, label: str = LABEL) -> DataFrame:
    """(part, label, n, copies) from originals: one row a class of each part."""
    counts = df.groupBy(*part, label).agg(F.count("*").alias("n"))
    every = W.partitionBy(*part) if part else W.partitionBy(F.lit(0))
    return counts.withColumn("copies", copies(F.col("n"), F.max("n").over(every), base, most))


def training_rows(table: DataFrame, part: list[str], multipliers: DataFrame, seed: int | Column, key: str = ID, label: str = LABEL) -> DataFrame:
    """Originals and the first copies of each photo in a seeded order, as many as its class has.

    table has every transform of the photos to train on; a class without a multiplier gets none."""
    order = W.partitionBy(*part, key).orderBy(F.when(F.col(AUGMENT) == ORIGINAL, 0).otherwise(1), seeded(seed, key, AUGMENT), AUGMENT)
    named = multipliers.select(*part, label, "copies")  # one row a class
    return table.withColumn("_place", F.row_number().over(order) - 1).join(F.broadcast(named), [*part, label], "left").filter((F.col(AUGMENT) == ORIGINAL) | ((F.col("_place") >= 1) & (F.col("_place") <= F.coalesce("copies", F.lit(0))))).drop("_place", "copies")
