"""Bytes to scaled arrays and back, and borders."""

from __future__ import annotations

import numpy as np

#: Sums of weights come in any order; values this near below a half count as a half.
TIE = 1e-9
BORDERS = ("repeat", "wrap", "mirror", "bounce")


def to_float(pixels: bytes, width: int, height: int, channels: int = 4) -> np.ndarray:
    return np.frombuffer(pixels, np.uint8).reshape(height, width, channels) / 255.0


def to_bytes(v: np.ndarray) -> np.ndarray:
    """Clamp, scale, add a half, cut."""
    return np.floor(np.nan_to_num(np.clip(v, 0, 1)) * 255 + 0.5 + TIE).astype(np.uint8)


def quantized(v: np.ndarray) -> np.ndarray:
    return to_bytes(v) / 255.0


def associated(v: np.ndarray) -> np.ndarray:
    out = v.copy()
    out[..., :3] *= v[..., 3:]
    return out


def unassociated(v: np.ndarray) -> np.ndarray:
    out = v.copy()
    a = v[..., 3:]
    out[..., :3] = np.where(a > 0, v[..., :3] / np.where(a > 0, a, 1), v[..., :3])
    return out


def border_index(i: np.ndarray, low: int, high: int, mode: str = "repeat") -> np.ndarray:
    """Places outside low..high (both inside) led back: clamped, wrapped, mirrored with the edge twice, or bounced with the edge once."""
    n = high - low + 1
    k = i - low
    if mode == "repeat":
        return np.clip(i, low, high)
    if mode == "wrap":
        return low + k % n
    if mode == "mirror":
        k = k % (2 * n)
        return low + np.where(k < n, k, 2 * n - 1 - k)
    if mode == "bounce":
        if n == 1:
            return np.full_like(i, low)
        k = k % (2 * n - 2)
        return low + np.where(k < n, k, 2 * n - 2 - k)
    raise ValueError(mode)


def window_of(v: np.ndarray, rect):
    """(left, top, right, bottom) of a rectangle inside the frame, right and bottom outside."""
    h, w = v.shape[:2]
    if rect is None:
        return 0, 0, w, h
    return max(0, rect[0]), max(0, rect[1]), min(w, rect[0] + rect[2]), min(h, rect[1] + rect[3])


def luma(v: np.ndarray) -> np.ndarray:
    return 0.2126 * v[..., 0] + 0.7152 * v[..., 1] + 0.0722 * v[..., 2]


def luma8(v: np.ndarray) -> np.ndarray:
    b = to_bytes(v).astype(np.float64)
    return np.floor(0.2126 * b[..., 0] + 0.7152 * b[..., 1] + 0.0722 * b[..., 2] + 0.5).astype(np.int64)
