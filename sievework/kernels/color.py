"""8-bit colour conversions and colour statistics."""

from __future__ import annotations

import numpy as np

from ..schema import EmptyRegionError
from .morphology import ellipse, erode

# sRGB to XYZ, rows divided by the white point.
_XYZ = np.array([[0.412453, 0.357580, 0.180423], [0.212671, 0.715160, 0.072169], [0.019334, 0.119193, 0.950227]]) / np.array([[0.950456], [1.0], [1.088754]])
_LINEAR = np.where(np.arange(256) / 255 <= 0.04045, np.arange(256) / 255 / 12.92, ((np.arange(256) / 255 + 0.055) / 1.055) ** 2.4)


def to_gray(rgb: np.ndarray) -> np.ndarray:
    return np.rint(rgb.astype(np.float64) @ np.array([0.299, 0.587, 0.114])).astype(np.uint8)


def to_hsv(rgb: np.ndarray) -> np.ndarray:
    """h 0-179, s and v 0-255, rounded."""
    c = rgb.astype(np.float64)
    r, g, b = c[..., 0], c[..., 1], c[..., 2]
    high, low = c.max(axis=-1), c.min(axis=-1)
    span = high - low
    safe = np.where(span == 0, 1, span)
    turn = np.where(high == r, 60 * (g - b) / safe, np.where(high == g, 120 + 60 * (b - r) / safe, 240 + 60 * (r - g) / safe))
    turn = np.where(span == 0, 0, np.where(turn < 0, turn + 360, turn))
    return np.stack([np.rint(turn / 2) % 180, np.rint(np.where(high == 0, 0, 255 * span / np.where(high == 0, 1, high))), high], axis=-1).astype(np.uint8)


def to_lab(rgb: np.ndarray) -> np.ndarray:
    """L times 255 / 100, a and b plus 128, rounded."""
    xyz = _LINEAR[rgb] @ _XYZ.T
    f = np.where(xyz > 0.008856, np.cbrt(xyz), 7.787 * xyz + 16 / 116)
    light = np.where(xyz[..., 1] > 0.008856, 116 * f[..., 1] - 16, 903.3 * xyz[..., 1])
    out = np.stack([light * 255 / 100, 500 * (f[..., 0] - f[..., 1]) + 128, 200 * (f[..., 1] - f[..., 2]) + 128], axis=-1)
    return np.clip(np.rint(out), 0, 255).astype(np.uint8)


def hue_stats(hue: np.ndarray) -> tuple[float, float]:
    """Circular mean and deviation in hue units; equal hues have none."""
    turn = hue * (np.pi / 90)
    sine, cosine = float(np.sin(turn).mean()), float(np.cos(turn).mean())
    length = min(float(np.hypot(sine, cosine)), 1.0)
    spread = 0.0 if length > 1 - 1e-12 else float(np.sqrt(-2 * np.log(max(length, 1e-12))))
    return float(np.arctan2(sine, cosine) % (2 * np.pi)) * 90 / np.pi, spread * 90 / np.pi


def color_features(rgb: np.ndarray, mask: np.ndarray | None = None, erode_px: int = 2) -> dict[str, float]:
    """Mean and deviation of H, S, V, L, a and b over the object, less a margin if that leaves any."""
    if rgb.dtype != np.uint8 or rgb.ndim != 3 or rgb.shape[2] != 3:
        raise ValueError(f"an RGB image of uint8 is needed, not {rgb.dtype} {rgb.shape}")
    if mask is not None and mask.shape != rgb.shape[:2]:
        raise ValueError(f"mask {mask.shape} does not fit image {rgb.shape[:2]}")
    region = (rgb != 0).any(axis=-1) if mask is None else mask.astype(bool)
    if not region.any():
        raise EmptyRegionError("no object pixels")
    if erode_px > 0:
        inner = erode(region, ellipse(2 * erode_px + 1))
        region = inner if inner.any() else region
    out = {}
    for space, image in (("hsv", to_hsv(rgb)), ("lab", to_lab(rgb))):
        for k, channel in enumerate(space):
            values = image[..., k][region].astype(np.float64)
            mean, sd = hue_stats(values) if channel == "h" else (float(values.mean()), float(values.std()))
            out[f"{space}_{channel}_mean"], out[f"{space}_{channel}_std"] = mean, sd
    return out
