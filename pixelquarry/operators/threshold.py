"""Thresholds: binary by luminance, saturation or chroma, and adaptive by an integral image."""

from __future__ import annotations

from ..frames import process_pixels
from ..functions.expr import KEYS, half_even, inside, luma8, num, operator, scaled
from ..kernels import threshold as kernel

WHITE, BLACK = (255, 255, 255, 255), (0, 0, 0, 255)


def _pick(condition: str, upper, lower, keep: str | None = None) -> str:
    """Columns of two colours by a condition."""
    cols = []
    for c, u, w in zip("rgba", upper, lower):
        v = f"CASE WHEN {condition} THEN {u} ELSE {w} END"
        cols.append((f"CASE WHEN {keep} THEN {v} ELSE {c} END" if keep else v) + f" AS {c}")
    return ", ".join(cols)


def _saturation() -> str:
    r, g, b = (scaled(c) for c in "rgb")
    high, low = f"greatest({r}, {g}, {b})", f"least({r}, {g}, {b})"
    return f"(CASE WHEN {high} - {low} < 0.001e0 THEN 0e0 WHEN ({high} + {low}) * 0.5e0 <= 0.5e0 THEN ({high} - {low}) / ({high} + {low}) ELSE ({high} - {low}) / (2e0 - {high} - {low}) END)"


def _chroma() -> str:
    cb, cr = "128e0 + (-0.168736e0 * r - 0.331264e0 * g + 0.5e0 * b)", "128e0 + (0.5e0 * r - 0.418688e0 * g - 0.081312e0 * b)"
    return f"greatest(abs({cb} - 127.5e0), abs({cr} - 127.5e0))"


@operator
def binary_threshold(source, threshold: float, upper=WHITE, lower=BLACK, mode: str = "luminance", rect=None):
    """Two colours by 8-bit luminance, HSL saturation or the larger chroma, whichever mode says; at the threshold it is the upper one."""
    t = half_even(num(threshold * 255))
    condition = {"luminance": f"{luma8()} >= {t}", "saturation": f"{_saturation()} >= {t} / 255e0", "max_chroma": f"{_chroma()} >= {t} * 0.5e0"}[mode]
    return f"SELECT {KEYS}, {_pick(condition, upper, lower, rect and inside(rect))} FROM {source}"


@operator
def integral_image(source, rect=None):
    """(keys, l, s): s is the sum of 8-bit luminance over all pixels above and left, its own row and column included. Two prefix sums; x and y count from rect's corner."""
    x0, y0 = (rect[0], rect[1]) if rect else (0, 0)
    where = f" WHERE {inside(rect)}" if rect else ""
    rows = f"SELECT image_id, frame_no, y - {y0} AS y, x - {x0} AS x, {luma8()} AS l FROM {source}{where}"
    across = f"SELECT {KEYS}, l, sum(CAST(l AS BIGINT)) OVER (PARTITION BY image_id, frame_no, y ORDER BY x ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS row_sum FROM ({rows}) AS picked"
    return f"SELECT {KEYS}, l, CAST(sum(row_sum) OVER (PARTITION BY image_id, frame_no, x ORDER BY y ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) AS s FROM ({across}) AS across"


def _adaptive_sql(source, limit: float = 0.85, upper=WHITE, lower=BLACK):
    """A pixel is the lower colour where it is darker than the limit's share of its neighbourhood's mean.

    The neighbourhood is a 16th of the width to each side, from one pixel after
    its lower bound; corners of the integral image come by equality joins.
    """
    table = integral_image.sql(source)
    sized = f"SELECT *, max(x) OVER (PARTITION BY image_id, frame_no) AS mx, max(y) OVER (PARTITION BY image_id, frame_no) AS my FROM ({table}) AS summed"
    k = "CAST(least(255e0, floor((mx + 1) / 16e0)) AS INT)"
    corners = f"SELECT *, greatest(0, least(mx, x - {k} + 1)) AS x1, least(mx, x + {k} + 1) AS x2, greatest(0, least(my, y - {k} + 1)) AS y1, least(my, y + {k} + 1) AS y2 FROM ({sized}) AS sized"
    joins, sums = "", {}
    for name, xx, yy in (("s22", "x2", "y2"), ("s12", "x1", "y2"), ("s21", "x2", "y1"), ("s11", "x1", "y1")):
        joins += f" JOIN ({table}) AS {name} ON {name}.image_id = c.image_id AND {name}.frame_no = c.frame_no AND {name}.x = c.{xx} AND {name}.y = c.{yy}"
        sums[name] = f"{name}.s"
    total = f"({sums['s22']} - {sums['s12']} - {sums['s21']} + {sums['s11']})"
    dark = f"c.l * ((c.x2 - c.x1) * (c.y2 - c.y1)) <= {total} * {num(limit)}"
    return f"SELECT c.image_id, c.frame_no, c.y, c.x, {_pick(dark, lower, upper)} FROM ({corners}) AS c{joins}"


def adaptive_threshold(px, limit: float = 0.85, upper=WHITE, lower=BLACK):
    """A pixel is the lower colour where it is darker than the limit's share of its neighbourhood's mean; a summed table of each packed frame."""
    return process_pixels(px, kernel.adaptive_threshold, limit, upper, lower)


adaptive_threshold.sql = _adaptive_sql
