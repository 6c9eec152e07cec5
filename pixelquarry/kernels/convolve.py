"""Convolution, blur, sharpening, edges, medians and brushes."""

from __future__ import annotations

import math

import numpy as np

from .base import associated, border_index, luma, quantized, to_bytes, unassociated, window_of


def _gathered(v, box, dy, dx, border_x, border_y):
    """The window shifted by (dy, dx), with borders at the window's own bounds."""
    left, top, right, bottom = box
    ys = border_index(np.arange(top, bottom) + dy, top, bottom - 1, border_y)
    xs = border_index(np.arange(left, right) + dx, left, right - 1, border_x)
    return v[ys[:, None], xs[None, :]]


def _put(v, box, part):
    out = v.copy()
    left, top, right, bottom = box
    out[top:bottom, left:right] = part
    return out


def _correlated(v, kernel, box, border_x, border_y):
    kh, kw = kernel.shape
    total = np.zeros((box[3] - box[1], box[2] - box[0], v.shape[2]))
    for i in range(kh):
        for j in range(kw):
            if kernel[i, j]:
                total += kernel[i, j] * _gathered(v, box, i - kh // 2, j - kw // 2, border_x, border_y)
    return total


def convolve(v, kernel, preserve_alpha=False, rect=None, border_x="repeat", border_y="repeat"):
    """Correlation with a dense kernel; alpha is either kept or weighs the colours."""
    kernel, box = np.atleast_2d(np.asarray(kernel, float)), window_of(v, rect)
    left, top, right, bottom = box
    if preserve_alpha:
        part = _correlated(v, kernel, box, border_x, border_y)
        part[..., 3] = v[top:bottom, left:right, 3]
    else:
        part = unassociated(np.clip(_correlated(associated(v), kernel, box, border_x, border_y), 0, 1))
    return _put(v, box, np.clip(part, 0, 1))


def separable(v, kernel, preserve_alpha=False, rect=None, border_x="repeat", border_y="repeat"):
    """A line's kernel along rows, then columns; what lies between is rounded to bytes."""
    row = np.asarray(kernel, float)
    first = quantized(convolve(v, row[None, :], preserve_alpha, rect, border_x, border_y))
    return convolve(first, row[:, None], preserve_alpha, rect, border_x, border_y)


def box_kernel(radius: int) -> np.ndarray:
    return np.full(2 * radius + 1, 1 / (2 * radius + 1))


def gaussian_kernel(sigma: float) -> np.ndarray:
    r = math.ceil(sigma * 3)
    k = np.exp(-(np.arange(-r, r + 1) ** 2) / (2 * sigma * sigma)) / (math.sqrt(2 * math.pi) * sigma)
    return k / k.sum()


def sharpen_kernel(sigma: float) -> np.ndarray:
    """The Gaussian turned round: its middle is twice the sum less itself, all others are negative."""
    r = math.ceil(sigma * 3)
    k = np.exp(-(np.arange(-r, r + 1) ** 2) / (2 * sigma * sigma)) / (math.sqrt(2 * math.pi) * sigma)
    total, out = k.sum(), -k
    out[r] = 2 * total - k[r]
    return out / out.sum()


def box_blur(v, radius=7, rect=None, border_x="repeat", border_y="repeat"):
    return separable(v, box_kernel(radius), False, rect, border_x, border_y)


def gaussian_blur(v, sigma=3.0, rect=None, border_x="repeat", border_y="repeat"):
    return separable(v, gaussian_kernel(sigma), False, rect, border_x, border_y)


def gaussian_sharpen(v, sigma=3.0, rect=None, border_x="repeat", border_y="repeat"):
    return separable(v, sharpen_kernel(sigma), False, rect, border_x, border_y)


def separated(kernel, tolerance=1e-4):
    """(column, row) whose outer product is the kernel, or None."""
    k = np.asarray(kernel, float)
    i, j = np.unravel_index(np.abs(k).argmax(), k.shape)
    if not k[i, j]:
        return None
    column, row = k[:, j], k[i] / k[i, j]
    return (column, row) if np.abs(np.outer(column, row) - k).max() <= tolerance else None


def median_blur(v, radius: int, preserve_alpha=False, rect=None):
    """Of each channel the value at half the sorted window, one above the middle (odd windows)."""
    box = window_of(v, rect)
    n = 2 * radius + 1
    stack = np.stack([_gathered(v, box, dy, dx, "repeat", "repeat") for dy in range(-radius, radius + 1) for dx in range(-radius, radius + 1)])
    at = (n * n + 1) >> 1
    part = np.sort(stack, axis=0)[min(at, n * n - 1)]
    if preserve_alpha:
        part[..., 3] = v[box[1] : box[3], box[0] : box[2], 3]
    return _put(v, box, part)


# The well-known edge kernels.
SOBEL_X = ((-1, 0, 1), (-2, 0, 2), (-1, 0, 1))
SOBEL_Y = ((-1, -2, -1), (0, 0, 0), (1, 2, 1))
SCHARR_X = ((-3, 0, 3), (-10, 0, 10), (-3, 0, 3))
SCHARR_Y = ((3, 10, 3), (0, 0, 0), (-3, -10, -3))
PREWITT_X = ((-1, 0, 1), (-1, 0, 1), (-1, 0, 1))
PREWITT_Y = ((1, 1, 1), (0, 0, 0), (-1, -1, -1))
ROBERTS_X = ((1, 0), (0, -1))
ROBERTS_Y = ((0, 1), (-1, 0))
KAYYALI_X = ((6, 0, -6), (0, 0, 0), (-6, 0, 6))
KAYYALI_Y = ((-6, 0, 6), (0, 0, 0), (6, 0, -6))
LAPLACIAN_3 = ((-1, -1, -1), (-1, 8, -1), (-1, -1, -1))
LAPLACIAN_5 = ((-1, -1, -1, -1, -1), (-1, -1, -1, -1, -1), (-1, -1, 24, -1, -1), (-1, -1, -1, -1, -1), (-1, -1, -1, -1, -1))
LAPLACIAN_OF_GAUSSIAN = ((0, 0, -1, 0, 0), (0, -1, -2, -1, 0), (-1, -2, 16, -2, -1), (0, -1, -2, -1, 0), (0, 0, -1, 0, 0))
KIRSCH_NORTH = ((5, 5, 5), (-3, 0, -3), (-3, -3, -3))
ROBINSON_NORTH = ((1, 2, 1), (0, 0, 0), (-1, -2, -1))

TWO_WAY = {"sobel": (SOBEL_X, SOBEL_Y), "scharr": (SCHARR_X, SCHARR_Y), "prewitt": (PREWITT_X, PREWITT_Y), "roberts_cross": (ROBERTS_X, ROBERTS_Y), "kayyali": (KAYYALI_X, KAYYALI_Y)}
ONE_WAY = {"laplacian_3x3": LAPLACIAN_3, "laplacian_5x5": LAPLACIAN_5, "laplacian_of_gaussian": LAPLACIAN_OF_GAUSSIAN}


def compass(north) -> list[np.ndarray]:
    """The eight turns of a 3x3 kernel: its ring moved on by one place each."""
    ring = [(0, 0), (0, 1), (0, 2), (1, 2), (2, 2), (2, 1), (2, 0), (1, 0)]
    k = np.array(north, float)
    out = []
    for turn in range(8):
        m = k.copy()
        for i, p in enumerate(ring):
            m[p] = k[ring[(i + turn) % 8]]
        out.append(m)
    return out


COMPASS = {"kirsch": KIRSCH_NORTH, "robinson": ROBINSON_NORTH}


def _gray(v, rect, gray):
    """Opaque, and gray where asked, inside the window; rounded to bytes as each step is."""
    left, top, right, bottom = box = window_of(v, rect)
    part = v[top:bottom, left:right].copy()
    part[..., 3] = 1
    if gray:
        part[..., :3] = luma(part)[..., None]
    return _put(v, box, quantized(part))


def detect_edges(v, kernel="sobel", gray=True, rect=None):
    v = _gray(v, rect, gray)
    left, top, right, bottom = box = window_of(v, rect)
    if kernel in ONE_WAY:
        return convolve(v, ONE_WAY[kernel], True, rect)
    if kernel in COMPASS:
        part = np.max([np.clip(_correlated(v, k, box, "repeat", "repeat"), 0, 1) for k in compass(COMPASS[kernel])], axis=0)
    else:
        gx, gy = (_correlated(v, np.array(k, float), box, "repeat", "repeat") for k in TWO_WAY[kernel])
        part = np.sqrt(gx * gx + gy * gy)
    part[..., 3] = v[top:bottom, left:right, 3]
    return _put(v, box, np.clip(part, 0, 1))


def oil_paint(v, levels=10, brush=15, rect=None):
    """The mean colour of the commonest brightness in the upper left quadrant of the brush; of equal counts the one that got there first."""
    left, top, right, bottom = box = window_of(v, rect)
    h, w = bottom - top, right - left
    r = brush >> 1
    counts, sums = np.zeros((h, w, levels), np.int64), np.zeros((h, w, levels, 3))
    best, most = np.zeros((h, w), np.int64), np.zeros((h, w), np.int64)
    yy, xx = np.mgrid[:h, :w]
    for fy in range(r + 1):
        for fx in range(r + 1):
            s = v[np.clip(yy + top + fy - r, 0, v.shape[0] - 1), np.clip(xx + left + fx - r, 0, v.shape[1] - 1)]
            b = np.rint(s[..., :3].sum(-1) / 3 * (levels - 1)).astype(np.int64)
            counts[yy, xx, b] += 1
            sums[yy, xx, b] += s[..., :3]
            now = counts[yy, xx, b]
            best, most = np.where(now > most, b, best), np.maximum(now, most)
    part = v[top:bottom, left:right].copy()
    part[..., :3] = np.abs(sums[yy, xx, best] / most[..., None])
    return _put(v, box, part)


def entropy_crop_box(v, threshold=0.5):
    """(x, y, width, height) of what edges leave above the threshold, by the blue channel."""
    edges = to_bytes(detect_edges(v, "sobel", False))
    t = round(threshold * 255)
    lum = np.floor(edges[..., :3] @ np.array([0.2126, 0.7152, 0.0722]) + 0.5)
    ys, xs = np.nonzero(lum >= t)
    if not len(ys):
        return 0, 0, v.shape[1], v.shape[0]
    return int(xs.min()), int(ys.min()), int(xs.max() - xs.min()) or 1, int(ys.max() - ys.min()) or 1


def entropy_crop(v, threshold=0.5):
    x, y, w, h = entropy_crop_box(v, threshold)
    return v[y : y + h, x : x + w]
