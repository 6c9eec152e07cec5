"""Filters by colour matrix: projections of exploded pixels, without any shuffle."""

from __future__ import annotations

import numpy as np

from ..functions import matrices as M
from ..functions.expr import KEYS, num, operator, pack, scaled, within


@operator
def filter_matrix(source, m: np.ndarray, rect=None):
    """Any 5x4 colour matrix on unassociated channels; pixels outside rect stay."""
    parts = [scaled(c) for c in "rgba"]

    def out(k: int) -> str:
        terms = [f"{num(m[j, k])} * {parts[j]}" for j in range(4) if m[j, k]]
        if m[4, k]:
            terms.append(num(m[4, k]))
        return within(rect, pack(" + ".join(terms) or "0e0"), "rgba"[k])

    cols = ", ".join(f"{out(k)} AS {c}" for k, c in enumerate("rgba"))
    return f"SELECT {KEYS}, {cols} FROM {source}"


def _named(make):
    """An operator of its own for a matrix; arguments are the matrix's, and rect."""

    @operator
    def run(source, *args, rect=None):
        return filter_matrix.sql(source, make(*args), rect)

    return run


brightness, contrast, hue, opacity = _named(M.brightness), _named(M.contrast), _named(M.hue), _named(M.opacity)
saturate, lightness, sepia, invert = _named(M.saturate), _named(M.lightness), _named(M.sepia), _named(M.invert)
grayscale, grayscale_bt601 = _named(M.grayscale_bt709), _named(M.grayscale_bt601)
black_white, kodachrome = _named(M.black_white), _named(M.kodachrome)


@operator
def color_blindness(source, mode: str, rect=None):
    return filter_matrix.sql(source, M.matrix(M.COLOR_BLINDNESS[mode]), rect)


@operator
def opaque(source, rect=None):
    """Alpha becomes one."""
    return f"SELECT {KEYS}, r, g, b, {within(rect, '255', 'a')} AS a FROM {source}"


@operator
def clear_transparent(source, threshold: int = 1):
    """Pixels whose alpha is below the threshold become transparent black (before palettes are built or pixels are encoded)."""
    cols = ", ".join(f"CASE WHEN a < {threshold} THEN 0 ELSE {c} END AS {c}" for c in "rgba")
    return f"SELECT {KEYS}, {cols} FROM {source}"


@operator
def luminance(source, bits: int = 8):
    """(keys, l): BT.709 luminance in 8 or 16 bits."""
    k = 1 if bits == 8 else 257
    return f"SELECT {KEYS}, CAST(floor(0.2126e0 * (r * {k}) + 0.7152e0 * (g * {k}) + 0.0722e0 * (b * {k}) + 0.5e0) AS INT) AS l FROM {source}"


@operator
def premultiply(source):
    """Associated alpha: colours times alpha, in bytes."""
    return f"SELECT {KEYS}, {', '.join(f'{pack(f'{scaled(c)} * {scaled('a')}')} AS {c}' for c in 'rgb')}, a FROM {source}"


@operator
def unpremultiply(source):
    return f"SELECT {KEYS}, {', '.join(f'CASE WHEN a = 0 THEN {c} ELSE {pack(f'{scaled(c)} / {scaled('a')}')} END AS {c}' for c in 'rgb')}, a FROM {source}"
