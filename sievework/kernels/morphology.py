"""Binary morphology, components, holes, blur and scaling."""

from __future__ import annotations

import numpy as np


def ellipse(size: int) -> np.ndarray:
    """The filled ellipse in a square, row by row from its equation."""
    r = size // 2
    dy = np.arange(size) - r
    reach = np.rint(r * np.sqrt(np.maximum(0, (r * r - dy * dy) / max(r * r, 1)))).astype(int)
    return np.abs(np.arange(size) - r)[None, :] <= reach[:, None]


def _swept(image: np.ndarray, kernel: np.ndarray, outside: bool, every: bool) -> np.ndarray:
    ry, rx = kernel.shape[0] // 2, kernel.shape[1] // 2
    padded = np.pad(image, ((ry, ry), (rx, rx)), constant_values=outside)
    out = np.full(image.shape, every)
    for y, x in np.argwhere(kernel):
        piece = padded[y : y + image.shape[0], x : x + image.shape[1]]
        out = out & piece if every else out | piece
    return out


def _square(image: np.ndarray, size: int, outside: bool, every: bool) -> np.ndarray:
    """By counts in running windows, along one axis after the other."""
    r = size // 2
    for axis in (0, 1):
        padded = np.pad(image, [(r, r) if a == axis else (0, 0) for a in (0, 1)], constant_values=outside)
        sums = np.cumsum(np.insert(padded.astype(np.int32), 0, 0, axis=axis), axis=axis)
        n = image.shape[axis]
        count = np.take(sums, np.arange(size, size + n), axis=axis) - np.take(sums, np.arange(n), axis=axis)
        image = count == size if every else count > 0
    return image


def erode(image: np.ndarray, kernel: np.ndarray | int) -> np.ndarray:
    """Beyond the frame counts as set."""
    image = image.astype(bool)
    return _square(image, kernel, True, True) if isinstance(kernel, int) else _swept(image, kernel, True, True)


def dilate(image: np.ndarray, kernel: np.ndarray | int) -> np.ndarray:
    image = image.astype(bool)
    return _square(image, kernel, False, False) if isinstance(kernel, int) else _swept(image, kernel, False, False)


def labelled(image: np.ndarray, eight: bool = True) -> np.ndarray:
    """Components numbered from 1 in the order of their first pixels; 0 is background.

    Runs of each row are nodes; runs that touch in neighbouring rows are united."""
    image = image.astype(bool)
    h, w = image.shape
    edge = np.diff(np.pad(image.astype(np.int8), ((0, 0), (1, 1))), axis=1)
    ys, begins = np.nonzero(edge == 1)
    _, ends = np.nonzero(edge == -1)
    parent = list(range(len(ys)))

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    first = np.searchsorted(ys, np.arange(h + 1))
    reach = 1 if eight else 0
    for y in range(1, h):
        i, j = int(first[y - 1]), int(first[y])
        stop_i, stop_j = j, int(first[y + 1])
        while i < stop_i and j < stop_j:
            if begins[i] < ends[j] + reach and begins[j] < ends[i] + reach:
                a, b = root(i), root(j)
                parent[max(a, b)] = min(a, b)
            if ends[i] < ends[j]:
                i += 1
            else:
                j += 1
    names = np.array([root(i) for i in range(len(ys))], np.int64)
    _, number = np.unique(names, return_inverse=True)
    out = np.zeros((h, w), np.int32)
    for y, a, b, n in zip(ys, begins, ends, number, strict=True):
        out[y, a:b] = n + 1
    return out


def largest(image: np.ndarray) -> np.ndarray:
    """The component with most pixels, the first on ties; none gives an empty mask."""
    labels = labelled(image)
    sizes = np.bincount(labels.ravel())[1:]
    return labels == 1 + int(sizes.argmax()) if len(sizes) else np.zeros(image.shape, bool)


def filled(image: np.ndarray) -> np.ndarray:
    """Background that does not reach the frame joins the object."""
    outside = labelled(np.pad(~image.astype(bool), 1, constant_values=True), eight=False)
    return (outside != outside[0, 0])[1:-1, 1:-1]


def blurred(image: np.ndarray, size: int = 5) -> np.ndarray:
    """Gaussian blur of uint8 channels, mirrored at the frame, with the usual deviation for a size."""
    sigma = 0.3 * ((size - 1) * 0.5 - 1) + 0.8
    taps = {3: np.array([1, 2, 1]) / 4, 5: np.array([1, 4, 6, 4, 1]) / 16}.get(size)
    if taps is None:
        taps = np.exp(-((np.arange(size) - size // 2) ** 2) / (2 * sigma * sigma))
        taps /= taps.sum()
    out, r = image.astype(np.float64), size // 2
    for axis in (0, 1):
        padded = np.pad(out, [(r, r) if a == axis else (0, 0) for a in range(out.ndim)], mode="reflect" if out.shape[axis] > r else "edge")
        out = sum(t * np.take(padded, np.arange(k, k + image.shape[axis]), axis=axis) for k, t in enumerate(taps))
    return np.clip(np.rint(out), 0, 255).astype(np.uint8)


def nearest(image: np.ndarray, width: int, height: int) -> np.ndarray:
    y = np.minimum(np.floor(np.arange(height) * (image.shape[0] / height)).astype(int), image.shape[0] - 1)
    x = np.minimum(np.floor(np.arange(width) * (image.shape[1] / width)).astype(int), image.shape[1] - 1)
    return image[y[:, None], x[None, :]]


def _cover(old: int, new: int) -> np.ndarray:
    """(new, old) shares of old cells that new ones cover."""
    edges = np.arange(new + 1) * (old / new)
    low, high = edges[:-1, None], edges[1:, None]
    cells = np.arange(old)[None, :]
    return np.clip(np.minimum(high, cells + 1) - np.maximum(low, cells), 0, None) * (new / old)


def area(image: np.ndarray, width: int, height: int) -> np.ndarray:
    """Mean over the area that each new pixel covers."""
    if (height, width) == image.shape[:2]:
        return image.copy()
    shrunk = np.tensordot(_cover(image.shape[0], height), image.astype(np.float64), (1, 0))
    shrunk = np.moveaxis(np.tensordot(_cover(image.shape[1], width), shrunk, (1, 1)), 0, 1)
    return np.clip(np.rint(shrunk), 0, 255).astype(np.uint8)
