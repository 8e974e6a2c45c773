"""Pictures brought to another size, and to what a scorer takes.

Resampling is separable: along each line an output value is a weighted sum of the input values within the
kernel's reach, which grows with the factor when a picture shrinks. Weights are rounded to ``BITS`` binary digits and
sums to eight bits after each of the two passes, across first, as the common imaging library does, so that
hashes of its users can be compared with ours.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np

#: Binary digits of a weight.
BITS = 22
# Side, means and deviations (red, green, blue) of what pretrained scorers expect.
SIDE = 224
MEAN, DEVIATION = (0.485, 0.456, 0.406), (0.229, 0.224, 0.225)


def triangle(x: np.ndarray) -> np.ndarray:
    return np.maximum(0.0, 1.0 - np.abs(x))


def lanczos(x: np.ndarray) -> np.ndarray:
    return np.where(np.abs(x) < 3, np.sinc(x) * np.sinc(x / 3), 0.0)


#: Kernels and how far they reach.
BILINEAR, LANCZOS = (triangle, 1.0), (lanczos, 3.0)


def line_weights(n: int, size: int, kernel: tuple[Callable, float]) -> np.ndarray:
    """Whole-number weights ``(size, n)`` of ``n`` values for each of ``size``."""
    of, reach = kernel
    factor = n / size
    wide = max(factor, 1.0)
    centre = ((np.arange(size) + 0.5) * factor)[:, None]
    low = np.maximum(np.trunc(centre - reach * wide + 0.5), 0)
    high = np.minimum(np.trunc(centre + reach * wide + 0.5), n)
    at = np.arange(n)[None]
    w = np.where((at >= low) & (at < high), of((at - centre + 0.5) / wide), 0.0)
    w /= w.sum(1, keepdims=True)
    return np.trunc(w * (1 << BITS) + np.copysign(0.5, w))


def resized(plane: np.ndarray, height: int, width: int, kernel: tuple[Callable, float] = BILINEAR) -> np.ndarray:
    """An eight-bit plane ``(rows, columns)`` in another size."""
    out = np.asarray(plane, np.float64)  # sums stay whole and below 2^53
    for axis, size in ((1, width), (0, height)):
        if out.shape[axis] != size:
            moved = np.moveaxis(out, axis, -1) @ line_weights(out.shape[axis], size, kernel).T
            out = np.moveaxis(np.clip(np.floor((moved + (1 << BITS - 1)) / (1 << BITS)), 0, 255), -1, axis)
    return out.astype(np.uint8)


def gray(red: np.ndarray, green: np.ndarray, blue: np.ndarray) -> np.ndarray:
    """Eight-bit luma with weights of sixteen binary digits."""
    return ((red.astype(np.int64) * 19595 + green.astype(np.int64) * 38470 + blue.astype(np.int64) * 7471 + 0x8000) >> 16).astype(np.uint8)


def scorer_input(pixels: np.ndarray, side: int = SIDE, mean: tuple = MEAN, deviation: tuple = DEVIATION) -> np.ndarray:
    """Eight-bit ``(rows, columns, 3)`` pixels, red first, as ``(3, side, side)`` numbers: resized, from 0 to 1, less the mean, by the deviation."""
    planes = np.stack([resized(pixels[:, :, c], side, side) for c in range(3)]).astype(np.float32) / np.float32(255)
    return (planes - np.array(mean, np.float32)[:, None, None]) / np.array(deviation, np.float32)[:, None, None]
