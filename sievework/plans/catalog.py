"""All queries of the engine and the SQL they are held against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import files, imaging, kernels, learning, tabular

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {**tabular.QUERIES, **imaging.QUERIES, **kernels.QUERIES, **files.QUERIES, **learning.QUERIES}
#: Held against SQL: the stream is a stateless map.
STREAM = "SELECT event_type, CASE WHEN value > 100 THEN 'high' ELSE 'low' END AS grade, count(*) AS n FROM events GROUP BY ALL"
ORACLES: dict[str, str] = {**tabular.ORACLES, **imaging.ORACLES, **kernels.ORACLES, **files.ORACLES, "stream_score": STREAM}
