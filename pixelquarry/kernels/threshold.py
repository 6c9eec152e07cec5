"""Thresholds that need a neighbourhood."""

from __future__ import annotations

import numpy as np

from .base import luma8


def adaptive_threshold(v, limit=0.85, upper=(255, 255, 255, 255), lower=(0, 0, 0, 255)):
    """Means come of one summed table. A neighbourhood reaches a 16th of the width (255 at most) to each side, from one pixel after its lower bound."""
    light = luma8(v)
    summed = light.cumsum(0).cumsum(1)
    h, w = light.shape
    reach = min(255, w // 16)
    ends = [(np.clip(np.arange(n) - reach + 1, 0, n - 1), np.clip(np.arange(n) + reach + 1, 0, n - 1)) for n in (h, w)]
    (y1, y2), (x1, x2) = ends
    total = summed[np.ix_(y2, x2)] - summed[np.ix_(y2, x1)] - summed[np.ix_(y1, x2)] + summed[np.ix_(y1, x1)]
    dark = light * np.outer(y2 - y1, x2 - x1) <= total * limit
    return np.where(dark[..., None], np.array(lower), np.array(upper)) / 255.0
