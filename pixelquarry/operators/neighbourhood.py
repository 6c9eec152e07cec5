"""Neighbourhood operators over exploded pixels: a kernel or weight table joined on the pixel's place, then a sum.

For small kernels and images. Each pixel meets every tap of the kernel, so for
wide kernels or large images the frame kernels (one row a frame, no shuffle) are
the way: see ``pixelquarry.kernels``.
"""

from __future__ import annotations

import numpy as np

from ..functions.expr import KEYS, num, operator

TIE = "1e-9"


def packed(v: str) -> str:
    """As pack(), with sums taken in any order: just below a half counts as a half."""
    return f"CAST(floor(255e0 * least(1e0, greatest(0e0, {v})) + 0.5e0 + {TIE}) AS INT)"


def border(i: str, n: str, mode: str) -> str:
    """A place led back into 0..n-1."""
    if mode == "repeat":
        return f"least({n} - 1, greatest(0, {i}))"
    if mode == "wrap":
        return f"((({i}) % {n} + {n}) % {n})"
    period = f"(2 * {n})" if mode == "mirror" else f"(2 * {n} - 2)"
    k = f"((({i}) % {period} + {period}) % {period})"
    return f"(CASE WHEN {k} < {n} THEN {k} ELSE {period} - {1 if mode == 'mirror' else 0} - {k} END)"


def _values(rows, names) -> str:
    return "(" + " UNION ALL ".join("SELECT " + ", ".join(f"{v} AS {n}" for v, n in zip(r, names)) for r in rows) + ")"


def taps(kernel, ident: int = 0) -> list[tuple]:
    k = np.atleast_2d(np.asarray(kernel, float))
    return [(ident, i - k.shape[0] // 2, j - k.shape[1] // 2, num(k[i, j])) for i in range(k.shape[0]) for j in range(k.shape[1]) if k[i, j]]


def _met(source, rows, columns: str, border_x="repeat", border_y="repeat") -> str:
    """(keys, kid, columns as sums): each pixel with its neighbours under the kernels."""
    sized = f"(SELECT image_id, frame_no, y, x, max(x) OVER (PARTITION BY image_id, frame_no) + 1 AS w, max(y) OVER (PARTITION BY image_id, frame_no) + 1 AS h FROM {source} AS all_px)"
    placed = f"(SELECT s.image_id, s.frame_no, s.y, s.x, k.kid, k.wt, {border('s.y + k.ky', 's.h', border_y)} AS qy, {border('s.x + k.kx', 's.w', border_x)} AS qx FROM {sized} AS s CROSS JOIN {_values(rows, ('kid', 'ky', 'kx', 'wt'))} AS k)"
    return f"SELECT p.image_id, p.frame_no, p.y, p.x, p.kid, {columns} FROM {placed} AS p JOIN {source} AS q ON q.image_id = p.image_id AND q.frame_no = p.frame_no AND q.y = p.qy AND q.x = p.qx GROUP BY p.image_id, p.frame_no, p.y, p.x, p.kid"


@operator
def convolve(source, kernel, preserve_alpha: bool = False, border_x: str = "repeat", border_y: str = "repeat"):
    rows = taps(kernel)
    if preserve_alpha:
        sums = ", ".join(f"sum(p.wt * (q.{c} / 255e0)) AS s{c}" for c in "rgb")
        met = _met(source, rows, sums, border_x, border_y)
        cols = ", ".join(f"{packed(f'm.s{c}')} AS {c}" for c in "rgb")
        return f"SELECT m.image_id, m.frame_no, m.y, m.x, {cols}, o.a FROM ({met}) AS m JOIN {source} AS o ON o.image_id = m.image_id AND o.frame_no = m.frame_no AND o.y = m.y AND o.x = m.x"
    sums = ", ".join(f"least(1e0, greatest(0e0, sum(p.wt * ((q.{c} / 255e0) * (q.a / 255e0))))) AS s{c}" for c in "rgb") + ", least(1e0, greatest(0e0, sum(p.wt * (q.a / 255e0)))) AS sa"
    met = _met(source, rows, sums, border_x, border_y)
    cols = ", ".join(f"{packed(f'CASE WHEN sa > 0e0 THEN s{c} / sa ELSE s{c} END')} AS {c}" for c in "rgb")
    return f"SELECT image_id, frame_no, y, x, {cols}, {packed('sa')} AS a FROM ({met}) AS m"


@operator
def separable(source, kernel, border_x: str = "repeat", border_y: str = "repeat"):
    """Rows, then columns, with bytes between."""
    row = np.asarray(kernel, float)
    return convolve.sql(f"({convolve.sql(source, row[None, :], False, border_x, border_y)})", row[:, None], False, border_x, border_y)


def _opaque_gray(source, gray: bool) -> str:
    v = "CAST(floor(255e0 * (0.2126e0 * (r / 255e0) + 0.7152e0 * (g / 255e0) + 0.0722e0 * (b / 255e0)) + 0.5e0 + 1e-9) AS INT)"
    cols = ", ".join(f"{v if gray else c} AS {c}" for c in "rgb")
    return f"(SELECT {KEYS}, {cols}, 255 AS a FROM {source} AS px0)"


@operator
def edges_two_way(source, kernel_x, kernel_y, gray: bool = True):
    """The root of two passes' squares."""
    rows = [(0, y, x, w) for _, y, x, w in taps(kernel_x)] + [(1, y, x, w) for _, y, x, w in taps(kernel_y)]
    met = _met(_opaque_gray(source, gray), rows, ", ".join(f"sum(p.wt * (q.{c} / 255e0)) AS s{c}" for c in "rgb"))
    cols = ", ".join(f"{packed(f'sqrt(sum(s{c} * s{c}))')} AS {c}" for c in "rgb")
    return f"SELECT image_id, frame_no, y, x, {cols}, 255 AS a FROM ({met}) AS m GROUP BY image_id, frame_no, y, x"


@operator
def edges_compass(source, kernels, gray: bool = True):
    """The largest of all passes."""
    rows = [r for k, m in enumerate(kernels) for r in taps(m, k)]
    met = _met(_opaque_gray(source, gray), rows, ", ".join(f"sum(p.wt * (q.{c} / 255e0)) AS s{c}" for c in "rgb"))
    cols = ", ".join(f"{packed(f'max(s{c})')} AS {c}" for c in "rgb")
    return f"SELECT image_id, frame_no, y, x, {cols}, 255 AS a FROM ({met}) AS m GROUP BY image_id, frame_no, y, x"


@operator
def edges_one_way(source, kernel, gray: bool = True):
    met = _met(_opaque_gray(source, gray), taps(kernel), ", ".join(f"sum(p.wt * (q.{c} / 255e0)) AS s{c}" for c in "rgb"))
    cols = ", ".join(f"{packed(f's{c}')} AS {c}" for c in "rgb")
    return f"SELECT image_id, frame_no, y, x, {cols}, 255 AS a FROM ({met}) AS m"


@operator
def resize(source, weights_x, weights_y):
    """Columns, then rows, by tables of weights (target x source); premultiplied."""
    def rows(w):
        return [(d, s, num(w[d, s])) for d in range(w.shape[0]) for s in range(w.shape[1]) if w[d, s]]

    pre = f"(SELECT image_id, frame_no, y, x, (r / 255e0) * (a / 255e0) AS r, (g / 255e0) * (a / 255e0) AS g, (b / 255e0) * (a / 255e0) AS b, a / 255e0 AS a FROM {source} AS px0)"
    across = f"(SELECT q.image_id, q.frame_no, q.y, k.d AS x, {', '.join(f'sum(k.wt * q.{c}) AS {c}' for c in 'rgba')} FROM {pre} AS q JOIN {_values(rows(weights_x), ('d', 's', 'wt'))} AS k ON k.s = q.x GROUP BY q.image_id, q.frame_no, q.y, k.d)"
    down = f"(SELECT q.image_id, q.frame_no, k.d AS y, q.x, {', '.join(f'least(1e0, greatest(0e0, sum(k.wt * q.{c}))) AS {c}' for c in 'rgba')} FROM {across} AS q JOIN {_values(rows(weights_y), ('d', 's', 'wt'))} AS k ON k.s = q.y GROUP BY q.image_id, q.frame_no, k.d, q.x)"
    cols = ", ".join(f"{packed(f'CASE WHEN a > 0e0 THEN {c} / a ELSE {c} END')} AS {c}" for c in "rgb")
    return f"SELECT image_id, frame_no, y, x, {cols}, {packed('a')} AS a FROM {down} AS d"
