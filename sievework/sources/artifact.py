"""A model on disk with everything that scoring needs."""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass
from typing import Any

from pyspark.ml import PipelineModel
from pyspark.sql import SparkSession

from ..operators.models import Fitted
from ..schema import Settings
from .manifest import exists

#: What of the settings scoring depends on; the rest stays behind.
SCORING = ("masking_method", "background_threshold_k", "grabcut_iters", "resize_to", "normalize", "reference_grey", "glcm_distances", "glcm_angles", "canny_low", "canny_high", "exclude_boundary", "boundary_margin_px")


@dataclass(frozen=True)
class Artifact:
    model: Fitted
    settings: Settings
    params: dict[str, Any]
    extra: dict[str, Any]


def save_artifact(model: Fitted, settings: Settings, path: str, params: dict[str, Any] | None = None, extra: dict[str, Any] | None = None) -> str:
    """Overwrites path with the pipeline and a manifest, through Spark's file systems."""
    spark = SparkSession.getActiveSession()
    model.pipeline.write().overwrite().save(f"{path}/model")
    manifest = {"name": model.name, "classes": model.classes, "columns": list(model.columns), "params": params or {}, "settings": {k: v for k, v in asdict(settings).items() if k in SCORING}, "extra": extra or {}}
    spark.createDataFrame([(json.dumps(manifest, default=str),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/manifest")
    return path


def load_artifact(spark: SparkSession, path: str) -> Artifact:
    """A missing folder, manifest or model is an error: nothing is graded without them."""
    for part in ("", "/manifest", "/model"):
        if not exists(spark, path + part):
            raise FileNotFoundError(f"artifact part missing: {path}{part}")
    m = json.loads("".join(r.value for r in spark.read.text(f"{path}/manifest").collect()))
    settings = Settings(**{k: tuple(v) if isinstance(v, list) else v for k, v in m["settings"].items()})
    return Artifact(Fitted(m["name"], PipelineModel.load(f"{path}/model"), tuple(m["columns"])), settings, m["params"], m["extra"])
