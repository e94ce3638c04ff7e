"""From photos to feature rows: masks once a photo, features once a transform."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..kernels import masking, morphology, texture
from ..schema import AUGMENT, BATCH, COVERAGE, ID, LABEL, TRANSFORMS, EmptyRegionError, Settings
from ..sources.images import parts, pixels


def feature_names(settings: Settings) -> list[str]:
    """Texture, colour, edges: the order that models record."""
    texture_ = [f"glcm_d{d}_a{a}_{s}" for d in settings.glcm_distances for a in settings.glcm_angles for s in ("contrast", "homogeneity", "energy", "entropy")]
    colors = [f"{space}_{c}_{s}" for space in ("hsv", "lab") for c in space for s in ("mean", "std")]
    return texture_ + colors + [f"edge_{s}" for s in ("density", "contour_count", "contour_density", "contour_mean_length", "contour_max_length")]


def photo_rows(image: np.ndarray | None, settings: Settings, transforms: tuple[str, ...] = TRANSFORMS) -> tuple[list[dict], str | None]:
    """(a row for each transform, None), or (no rows, why not): a photo goes whole or not at all."""
    if image is None:
        return [], "could not be read"
    crop, mask = masking.masked_crop(image, settings)
    rows = []
    for name in transforms:
        try:
            turned = morphology.nearest(texture.transformed(crop, name), *settings.resize_to)
            rows.append({AUGMENT: name, COVERAGE: float(mask.mean()), **texture.all_features(turned, settings)})
        except EmptyRegionError as error:
            return [], f"{name}: {error}"
    return rows, None


def feature_rows(photos: DataFrame, settings: Settings, transforms: tuple[str, ...] = TRANSFORMS) -> DataFrame:
    """id, batch_id, class, augment, mask_fraction, features and error of photos with an image column.

    One pass without a shuffle; a photo without rows has one, with its error."""
    keys = [c for c in (ID, BATCH, LABEL) if c in photos.columns]
    names = feature_names(settings)
    schema = T.StructType([T.StructField(c, T.StringType()) for c in (*keys, AUGMENT)] + [T.StructField(c, T.DoubleType()) for c in (COVERAGE, *names)] + [T.StructField("error", T.StringType())])

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for record in batch.to_dict("records"):
                own = {c: record[c] for c in keys}
                rows, error = photo_rows(pixels(record), settings, transforms)
                out += [own | r | {"error": None} for r in rows] or [own | {AUGMENT: None, "error": error}]
            yield pd.DataFrame(out, columns=[f.name for f in schema])

    return photos.select(*keys, *parts()).mapInPandas(work, schema)


def feature_table(photos: DataFrame, settings: Settings, transforms: tuple[str, ...] = TRANSFORMS) -> tuple[DataFrame, DataFrame]:
    """(feature table, skipped photos with the reason). Both read one pass; write it first if it is
    large, as each of the two runs it."""
    rows = feature_rows(photos, settings, transforms)
    return rows.filter(F.col("error").isNull()).drop("error"), rows.filter(F.col("error").isNotNull()).select(ID, F.col("error").alias("reason"))


def paper_table(photos: DataFrame, reference: float | None = None) -> DataFrame:
    """id, batch_id, class and the background's statistics of each photo that could be read."""
    names = [f"paper_{c}_{s}" for c in "lab" for s in ("mean", "std")]
    schema = T.StructType([T.StructField(c, T.StringType()) for c in (ID, BATCH, LABEL)] + [T.StructField(c, T.DoubleType()) for c in names])

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = [{c: r[c] for c in (ID, BATCH, LABEL)} | masking.paper_features(image, reference) for r in batch.to_dict("records") if (image := pixels(r)) is not None]
            yield pd.DataFrame(found, columns=[f.name for f in schema])

    return photos.select(ID, BATCH, LABEL, *parts()).mapInPandas(work, schema)
