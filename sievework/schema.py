"""Names, types, classes and settings that all parts share."""

from __future__ import annotations

from dataclasses import dataclass, field, replace
from typing import Any

from pyspark.sql import types as T

# Class letters in order of moisture, wettest last.
MOISTURE_ORDER = ("F", "A", "B", "C", "D", "E")
CLASSES = tuple(sorted(MOISTURE_ORDER))
PHOTOS_PER_BATCH = 4
ID, BATCH, LABEL, PATH, AUGMENT, COVERAGE = "id", "batch_id", "class", "path", "augment", "mask_fraction"
REQUIRED = (ID, BATCH, LABEL, PATH)
#: Header names that stand for a required column, if that is missing.
ALIASES = {"Photo photo": PATH}
META = (ID, BATCH, LABEL, PATH, AUGMENT, COVERAGE)
ORIGINAL = "rot0"
# The eight symmetries of a square; a flip comes before the quarter turns.
TRANSFORMS = ("rot0", "rot90", "rot180", "rot270", "flip", "flip_rot90", "flip_rot180", "flip_rot270")
FAMILIES = {"glcm_": "texture", "hsv_": "color", "lab_": "color", "edge_": "edge"}
BASELINE = "logistic_regression"
ENSEMBLES = ("random_forest", "xgboost", "lightgbm")
MODELS = (BASELINE, *ENSEMBLES)

MANIFEST = T.StructType([T.StructField(c, T.StringType()) for c in REQUIRED])


class DatasetError(ValueError):
    """The dataset breaks a rule; the message tells how many cases there are and lists the first."""


class EmptyRegionError(ValueError):
    """An image has no object pixels to measure."""


class UploadError(ValueError):
    """A file cannot be graded; the message is for the user."""


@dataclass(frozen=True)
class Settings:
    """All parameters. The defaults are those of the published configuration."""

    min_grade_ratio: float = 0.9
    balance_seed: int = 42
    masking_method: str = "background_grabcut"
    background_threshold_k: float = 4.0
    grabcut_iters: int = 3
    resize_to: tuple[int, int] = (512, 512)
    normalize: bool = True
    reference_grey: int = 110
    glcm_distances: tuple[int, ...] = (1, 2, 3)
    glcm_angles: tuple[int, ...] = (0, 45, 90, 135)
    canny_low: int = 100
    canny_high: int = 200
    exclude_boundary: bool = True
    boundary_margin_px: int = 3
    zscore: float = 3.0
    iqr: float = 1.5
    n_splits: int = 5
    inner_n_splits: int = 3
    seed: int = 42
    base_copies: int = 1
    max_copies: int = 4
    n_trials: int = 75
    marks: dict[str, Any] = field(default_factory=lambda: {"macro_f1": 0.75, "macro_f1_stretch": 0.80, "min_class_recall": 0.60, "precision_class": "A", "class_precision": 0.85})
    leak_accuracy: float = 0.25

    def inner(self, n_splits: int | None = None) -> Settings:
        """These settings with the inner number of folds, or the one given."""
        return replace(self, n_splits=n_splits or self.inner_n_splits)
