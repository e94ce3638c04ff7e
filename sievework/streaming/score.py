"""Grading of photos, alike in batch and as a stream: a stateless map."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.features import feature_names, photo_rows
from ..operators.metrics import PREDICTED
from ..schema import COVERAGE, ORIGINAL, Settings
from ..sources.artifact import Artifact
from ..sources.images import parts, pixels

# What the grades mean, for the user.
DESCRIPTIONS = {c: f"moisture class {c}" for c in "ABCDEF"}


IMAGE = T.StructType([T.StructField("origin", T.StringType()), *[T.StructField(c, T.IntegerType()) for c in ("height", "width", "nChannels", "mode")], T.StructField("data", T.BinaryType())])


def measured(photos: DataFrame, settings: Settings, key: str) -> DataFrame:
    """key, mask_fraction, features, error of photos with an image column (and, if there, an error)."""
    names = feature_names(settings)
    schema = T.StructType([T.StructField(key, T.StringType()), T.StructField("error", T.StringType())] + [T.StructField(c, T.DoubleType()) for c in (COVERAGE, *names)])
    has_error = "error" in photos.columns

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for r in batch.to_dict("records"):
                error = r["error"]
                rows, why = ([], error) if error else photo_rows(pixels(r), settings, (ORIGINAL,))
                out += [{key: r[key], "error": None} | x for x in rows] or [{key: r[key], "error": error or f"The object could not be measured ({why})."}]
            yield pd.DataFrame(out, columns=[f.name for f in schema])

    return photos.select(F.col(key).cast("string").alias(key), *parts(), (F.col("error") if has_error else F.lit(None)).cast("string").alias("error")).mapInPandas(work, schema)


def score(photos: DataFrame, artifact: Artifact, key: str = "path") -> DataFrame:
    """key, grade, description, error, mask_fraction: a grade or an error, never a default."""
    rows = measured(photos, artifact.settings, key)
    safe = rows.select(key, "error", COVERAGE, *[F.coalesce(F.col(f"`{c}`"), F.lit(0.0)).alias(c) for c in artifact.model.columns])
    graded = artifact.model.predict(safe)
    grade = F.when(F.col("error").isNull(), F.col(PREDICTED))
    described = F.coalesce(F.create_map(*[F.lit(x) for kv in DESCRIPTIONS.items() for x in kv])[grade], F.when(grade.isNotNull(), F.lit("")))
    return graded.select(key, grade.alias("grade"), described.alias("description"), "error", COVERAGE)


def score_stream(spark: SparkSession, path: str, artifact: Artifact, out: str, checkpoint: str, files_a_batch: int = 1000) -> None:
    """Grades all files below path that earlier runs have not, some files at a time, and ends."""
    from pyspark.sql.types import BinaryType, LongType, StringType, StructType, TimestampType

    from ..functions.scalar import upload_error

    schema = StructType().add("path", StringType()).add("modificationTime", TimestampType()).add("length", LongType()).add("content", BinaryType())
    raw = spark.readStream.format("binaryFile").schema(schema).option("maxFilesPerTrigger", files_a_batch).load(path)

    def grade(batch: DataFrame, _: int) -> None:
        judged = batch.select("path", upload_error(F.col("length"), F.substring("content", 1, 8)).alias("error"))
        paths = [r.path for r in judged.filter("error is null").select("path").collect()]  # names of files_a_batch files
        if not paths:
            both = judged.withColumn("image", F.lit(None).cast(IMAGE))
        else:
            images = spark.read.format("image").option("dropInvalid", False).load(paths).select(F.regexp_replace("image.origin", "^file:/+", "/").alias("path"), "image")
            both = judged.withColumn("path", F.regexp_replace("path", "^file:/+", "/")).join(images, "path", "left")
        score(both, artifact).write.mode("append").parquet(out)

    raw.writeStream.foreachBatch(grade).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def count_stream(spark: SparkSession, path: str, out: str, checkpoint: str) -> None:
    """The same shape on the events table: a stateless map of all files, run to their end."""
    schema = spark.read.parquet(path).schema
    events = spark.readStream.schema(schema).parquet(path)
    scored = events.select("event_id", "event_type", F.when(F.col("value") > 100, "high").otherwise("low").alias("grade"))
    scored.writeStream.format("parquet").option("checkpointLocation", checkpoint).trigger(availableNow=True).start(out).awaitTermination()
