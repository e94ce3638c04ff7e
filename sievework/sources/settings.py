"""Settings from YAML, reports to and from JSON; both on the driver, both small."""

from __future__ import annotations

import json
from dataclasses import fields
from pathlib import Path
from typing import Any

from ..schema import Settings

#: Where the nested configuration holds what Settings names.
PLACES = {
    "min_grade_ratio": ("data", "min_grade_ratio"), "balance_seed": ("data", "balance_seed"),
    "masking_method": ("preprocessing", "masking_method"), "background_threshold_k": ("preprocessing", "background_threshold_k"), "grabcut_iters": ("preprocessing", "grabcut_iters"), "resize_to": ("preprocessing", "resize_to"),
    "normalize": ("preprocessing", "lighting_normalization", "enabled"), "reference_grey": ("preprocessing", "lighting_normalization", "reference_grey"),
    "glcm_distances": ("features", "glcm", "distances"), "glcm_angles": ("features", "glcm", "angles_deg"), "canny_low": ("features", "canny", "low_threshold"), "canny_high": ("features", "canny", "high_threshold"),
    "exclude_boundary": ("features", "exclude_boundary"), "boundary_margin_px": ("features", "boundary_margin_px"),
    "zscore": ("cleaning", "zscore_threshold"), "iqr": ("cleaning", "iqr_multiplier"), "n_splits": ("splitting", "n_splits"), "seed": ("splitting", "random_state"),
    "base_copies": ("augmentation", "base_copies"), "max_copies": ("augmentation", "max_multiplier"), "n_trials": ("tuning", "n_trials"), "inner_n_splits": ("tuning", "inner_n_splits"),
    "marks": ("evaluation", "pass_marks"), "leak_accuracy": ("evaluation", "lighting_leak_accuracy"),
}


def from_mapping(nested: dict[str, Any]) -> Settings:
    """Settings from a nested mapping; what it lacks keeps its default."""
    found = {}
    for f in fields(Settings):
        at: Any = nested
        for key in PLACES[f.name]:
            at = at.get(key) if isinstance(at, dict) else None
        if at is not None:
            found[f.name] = tuple(at) if isinstance(at, list) else at
    return Settings(**found)


def load_settings(path: str | Path) -> Settings:
    import yaml

    return from_mapping(yaml.safe_load(Path(path).read_text()) or {})


def write_report(report: dict[str, Any], path: str | Path) -> None:
    Path(path).parent.mkdir(parents=True, exist_ok=True)
    Path(path).write_text(json.dumps(report, indent=2, default=str))


def read_report(path: str | Path) -> dict[str, Any]:
    return json.loads(Path(path).read_text())
