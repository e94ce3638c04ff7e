"""Photo lists, exclusions and feature tables: what is read and written as tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.checks import and_more, told
from ..schema import ALIASES, CLASSES, COVERAGE, ID, LABEL, META, REQUIRED, DatasetError


def exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def renamed(df: DataFrame) -> DataFrame:
    """Header aliases under their proper names, unless those are there too."""
    return df.withColumnsRenamed({k: v for k, v in ALIASES.items() if k in df.columns and v not in df.columns})


def require(df: DataFrame, columns: tuple[str, ...] = REQUIRED) -> DataFrame:
    if missing := [c for c in columns if c not in df.columns]:
        raise ValueError(f"columns missing: {', '.join(missing)}")
    return df


def unknown_values(df: DataFrame, column: str, allowed: tuple[str, ...]) -> DataFrame:
    """Distinct values of a column outside the allowed ones; a null counts."""
    return df.select(column).distinct().filter(F.col(column).isNull() | ~F.col(column).isin(*allowed))


def load_manifest(spark: SparkSession, path: str, allowed: tuple[str, ...] = CLASSES) -> DataFrame:
    """The photo list as strings (ids keep leading zeros), validated."""
    df = require(renamed(spark.read.csv(path, header=True)))
    n, bad = told(unknown_values(df, LABEL, allowed), LABEL)
    if n:
        raise ValueError(f"unknown classes: {and_more(n, [str(r[0]) for r in bad])}")
    return df


def load_exclusions(spark: SparkSession, path: str) -> DataFrame | None:
    """Photo ids to leave out; None if there is no such file."""
    if not exists(spark, path):
        return None
    return spark.read.csv(path, header=True).dropna(subset=[ID])


def exclude(df: DataFrame, exclusions: DataFrame | None, key: str = ID) -> tuple[DataFrame, DataFrame]:
    """(rows kept, ids dropped); an id that the list has and df lacks is an error."""
    if exclusions is None:
        return df, df.select(key).limit(0)
    listed = exclusions.select(key).distinct()
    n, unknown = told(listed.join(df.select(key).distinct(), key, "left_anti"), key)
    if n:
        raise ValueError(f"excluded ids that are not in the dataset: {and_more(n, [str(r[0]) for r in unknown])}")
    return df.join(listed, key, "left_anti"), df.join(listed, key, "left_semi").select(key)


def feature_columns(df: DataFrame) -> list[str]:
    """Every column that is not about the photo itself, in order."""
    return [c for c in df.columns if c not in META]


def write_table(df: DataFrame, path: str, csv: bool = False) -> None:
    """Overwrites; Parquet between steps, CSV (with a header even if empty) for people, where what is
    no single value is JSON."""
    if csv:
        simple = [F.to_json(f"`{f.name}`").alias(f.name) if isinstance(f.dataType, (T.MapType, T.StructType, T.ArrayType)) else F.col(f"`{f.name}`") for f in df.schema]
        df.select(*simple).write.mode("overwrite").csv(path, header=True)
    else:
        df.write.mode("overwrite").parquet(path)


def read_table(spark: SparkSession, path: str) -> DataFrame:
    """A written table. A CSV's numbers are numbers, but what is about the photo (ids above all) stays
    as it is written, zeros in front included; the share of the frame is a number."""
    if not path.rstrip("/").endswith(".csv"):
        return spark.read.parquet(path)
    found = spark.read.csv(path, header=True, inferSchema=True).schema
    text = set(META) - {COVERAGE}
    return spark.read.csv(path, header=True, schema=T.StructType([T.StructField(f.name, T.StringType() if f.name in text else f.dataType) for f in found]))
