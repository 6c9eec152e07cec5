"""Adaptive equalisation: by tiles with interpolation, or by a window that slides."""

from __future__ import annotations

import numpy as np

from .base import luma


def _table(hist: np.ndarray, clip: int | None) -> tuple[np.ndarray, int]:
    """(running sums less the first that isn't zero, that first one)"""
    h = hist.astype(np.int64).copy()
    levels = len(h)
    if clip is not None:
        excess = int(np.maximum(h - clip, 0).sum())
        h = np.minimum(h, clip) + excess // levels
        rest = excess - excess // levels * levels
        if rest:
            step = max(levels // rest, 1)
            h[np.arange(0, levels, step)[:rest]] += 1
    run = h.cumsum()
    least = int(run[np.flatnonzero(run)[0]]) if run.any() else 0
    return np.maximum(run - least, 0), least


def clahe(v, levels=256, clip: int | None = None, tiles=8):
    """Each pixel between the tables of the four tiles whose middles surround it; at the rim between two, in corners one."""
    h, w = v.shape[:2]
    th, tw = -(-h // tiles), -(-w // tiles)
    ny, nx = -(-h // th), -(-w // tw)
    bins = np.rint(luma(v) * (levels - 1)).astype(np.int64)
    tables = np.zeros((ny, nx, levels))
    for i in range(ny):
        for j in range(nx):
            part = bins[i * th : (i + 1) * th, j * tw : (j + 1) * tw]
            c, least = _table(np.bincount(part.ravel(), minlength=levels), clip)
            tables[i, j] = c / max(part.size - least, 1)

    def place(n, size, count):
        at = (np.arange(n) - size // 2) / size
        low = np.clip(np.floor(at).astype(int), 0, count - 1)
        high = np.clip(low + 1, 0, count - 1)
        inside = (np.arange(n) - (low * size + size // 2)) / max(size - 1, 1)
        return low, high, np.clip(np.where(at < 0, 0, inside), 0, 1)

    y0, y1, fy = place(h, th, ny)
    x0, x1, fx = place(w, tw, nx)
    look = lambda a, b: tables[a[:, None], b[None, :], bins]
    fy, fx = fy[:, None], fx[None, :]
    value = (look(y0, x0) * (1 - fx) + look(y0, x1) * fx) * (1 - fy) + (look(y1, x0) * (1 - fx) + look(y1, x1) * fx) * fy
    out = v.copy()
    out[..., :3] = value[..., None]
    return out


def clahe_sliding(v, levels=256, clip: int | None = None, tiles=8):
    """A histogram of a square (side = width / tiles) about each pixel, moved on by a row at a time; places outside are mirrored, right of the frame its last column."""
    h, w = v.shape[:2]
    side = max(1, w // tiles)
    half = side // 2
    bins = np.rint(luma(v) * (levels - 1)).astype(np.int64)
    ys = np.arange(-half, h + half + 1)
    ys = np.where(ys < 0, -ys, ys)
    ys = np.clip(np.where(ys >= h, h - 1 - (ys - h), ys), 0, h - 1)
    xs = np.arange(-half, w + half + 1)
    xs = np.clip(np.where(xs < 0, -xs, xs), 0, w - 1)
    grown = bins[ys][:, xs]
    out = v.copy()
    for x in range(w):
        hist = np.bincount(grown[:side, x : x + side].ravel(), minlength=levels)
        for y in range(h):
            c, least = _table(hist, clip)
            out[y, x, :3] = c[bins[y, x]] / max(side * side - least, 1)
            if y + 1 < h:
                hist = hist + np.bincount(grown[y + side, x : x + side], minlength=levels) - np.bincount(grown[y, x : x + side], minlength=levels)
    return out
