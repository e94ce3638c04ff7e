"""Photos with an outlying value in any feature."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..schema import AUGMENT, ID, META, ORIGINAL, Settings
from .ranking import column_quantiles

QUARTILES = {"q1": 0.25, "q3": 0.75}


def numeric_features(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType) and f.name not in META]


def long_form(df: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """keys, feature, value: a row for each value; NaN is null, so that it is in no statistic."""
    value = lambda c: F.when(~F.isnan(F.col(f"`{c}`").cast("double")), F.col(f"`{c}`").cast("double"))
    pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("feature"), value(c).alias("value")) for c in columns]))
    return df.select(*keys, pairs.alias("_p")).select(*keys, "_p.feature", "_p.value")


def statistics(df: DataFrame, columns: list[str]) -> DataFrame:
    """feature, mean, sd (population), q1, q3 of columns."""
    found = column_quantiles(df, columns, QUARTILES)
    return df.sparkSession.createDataFrame([(c, s["mean"], s["sd"], s["q1"], s["q3"]) for c, s in found.items()], "feature string, mean double, sd double, q1 double, q3 double")


def is_outlier(value: Column, mean: Column, sd: Column, q1: Column, q3: Column, zscore: float, iqr: float) -> Column:
    """Beyond zscore standard deviations, or the fence of iqr interquartile ranges. Without a spread
    a rule does not hold; without a value none does."""
    far = F.abs((value - mean) / F.nullif(sd, F.lit(0.0))) > zscore
    spread = q3 - q1
    fenced = (spread > 0) & ((value < q1 - iqr * spread) | (value > q3 + iqr * spread))
    return F.coalesce(far, F.lit(False)) | F.coalesce(fenced, F.lit(False))


def outlier_values(df: DataFrame, keys: list[str], columns: list[str], zscore: float = 3.0, iqr: float = 1.5) -> DataFrame:
    """keys, feature, value, outlier. Statistics, one row a feature, go to every task."""
    joined = long_form(df, keys, columns).join(F.broadcast(statistics(df, columns)), "feature")
    return joined.select(*keys, "feature", "value", is_outlier(*map(F.col, ("value", "mean", "sd", "q1", "q3")), zscore, iqr).alias("outlier"))


def outlier_flags(df: DataFrame, columns: list[str], zscore: float = 3.0, iqr: float = 1.5) -> dict[str, Column]:
    """For each column, whether a row's value is an outlier."""
    flags = {}
    for c, s in column_quantiles(df, columns, QUARTILES).items():
        v = F.when(~F.isnan(F.col(f"`{c}`").cast("double")), F.col(f"`{c}`").cast("double"))
        flags[c] = is_outlier(v, *[F.lit(s[x]).cast("double") for x in ("mean", "sd", "q1", "q3")], zscore, iqr)
    return flags


def _any(flags: dict[str, Column]) -> Column:
    return reduce(lambda a, b: a | b, flags.values(), F.lit(False))


def outlier_rows(df: DataFrame, keys: list[str], columns: list[str], zscore: float = 3.0, iqr: float = 1.5) -> DataFrame:
    """keys, flagged: whether any of a row's values is an outlier. Values stay in their row, so nothing
    but brackets of quantiles is shuffled."""
    return df.select(*keys, _any(outlier_flags(df, columns, zscore, iqr)).alias("flagged"))


def remove_outliers(df: DataFrame, key: str, columns: list[str] | None = None, zscore: float = 3.0, iqr: float = 1.5) -> tuple[DataFrame, DataFrame]:
    """(rows without an outlier in any column, key and a flag a column of every row); without columns,
    all numbers that are not about the photo itself."""
    flags = outlier_flags(df, numeric_features(df) if columns is None else columns, zscore, iqr)
    return df.filter(~_any(flags)), df.select(key, *[f.alias(c) for c, f in flags.items()])


def remove_outlier_photos(table: DataFrame, settings: Settings, key: str = ID) -> tuple[DataFrame, DataFrame]:
    """(rows kept, values flagged): outliers are found among originals, and a flagged photo loses all
    its transforms."""
    originals = table.filter(F.col(AUGMENT) == ORIGINAL) if AUGMENT in table.columns else table
    columns = numeric_features(originals)
    if not columns:
        return table, originals.select(key, F.lit("").alias("feature"), F.lit(0.0).alias("value")).limit(0)
    flagged = outlier_values(originals, [key], columns, settings.zscore, settings.iqr).filter("outlier").drop("outlier")
    return table.join(flagged.select(key).distinct(), key, "left_anti"), flagged


def most_flagged(flagged: DataFrame, n: int = 10) -> DataFrame:
    """The features with most flagged values, by number, then name."""
    return flagged.groupBy("feature").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "feature").limit(n)
