"""Palettes over exploded pixels: the nearest colours of a batch of pixels at once, ordered dither as an index expression. Nothing is joined or shuffled."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.expr import num
from ..kernels.quantize import nearest


def websafe() -> list[tuple[int, int, int, int]]:
    """Six steps of each channel."""
    steps = range(0, 256, 51)
    return [(r, g, b, 255) for r in steps for g in steps for b in steps]


def palette_values(palette) -> str:
    return "(" + " UNION ALL ".join(f"SELECT {i} AS idx, {r} AS pr, {g} AS pg, {b} AS pb, {a} AS pa" for i, (r, g, b, a) in enumerate(palette)) + ")"


def _quantize_sql(source, palette):
    far = "((c.r - q.pr) * (c.r - q.pr) + (c.g - q.pg) * (c.g - q.pg) + (c.b - q.pb) * (c.b - q.pb) + (c.a - q.pa) * (c.a - q.pa))"
    near = f"SELECT c.r, c.g, c.b, c.a, min(CAST({far} AS BIGINT) * 1024 + q.idx) % 1024 AS idx FROM (SELECT DISTINCT r, g, b, a FROM {source} AS px0) AS c CROSS JOIN {palette_values(palette)} AS q GROUP BY c.r, c.g, c.b, c.a"
    return f"SELECT p.image_id, p.frame_no, p.y, p.x, CAST(n.idx AS INT) AS idx, q.pr AS r, q.pg AS g, q.pb AS b, q.pa AS a FROM {source} AS p JOIN ({near}) AS n ON n.r = p.r AND n.g = p.g AND n.b = p.b AND n.a = p.a JOIN {palette_values(palette)} AS q ON q.idx = n.idx"


def index_of(palette):
    """A function of four channel columns: the number of the palette's nearest colour."""
    table = np.array(palette, np.int64)

    @F.pandas_udf("int")
    def idx(r: pd.Series, g: pd.Series, b: pd.Series, a: pd.Series) -> pd.Series:
        return pd.Series(nearest(np.stack([r, g, b, a], 1).astype(np.int64), table).astype(np.int32))

    return idx


def quantize(px: DataFrame, palette) -> DataFrame:
    """Each pixel takes the palette's nearest colour by squared distance over all channels; of equals the first. (keys, idx, r, g, b, a)"""
    found = px.select("image_id", "frame_no", "y", "x", index_of(palette)("r", "g", "b", "a").alias("idx"))
    return found.select("*", *(_of([p[k] for p in palette], F.col("idx")).alias(c) for k, c in enumerate("rgba")))


quantize.sql = _quantize_sql


def _of(values, at: Column) -> Column:
    """values[at]"""
    return F.element_at(F.array(*map(F.lit, values)), at + 1)


def bayer(n: int) -> np.ndarray:
    """The ordered matrix of size n: powers of two by doubling, 3 as it is known."""
    if n == 3:
        return np.array([[0, 5, 2], [7, 4, 8], [3, 6, 1]])
    m = np.zeros((1, 1), int)
    while len(m) < n:
        m = np.block([[4 * m, 4 * m + 2], [4 * m + 3, 4 * m + 1]])
    return m


def ordered_dither(px: DataFrame, palette, size: int = 8, scale: float = 1.0, left: int = 0) -> DataFrame:
    """A threshold by place is added to red, green and blue before the nearest colour is taken; x counts from the rectangle, y from the frame."""
    matrix = bayer(size)
    n = len(matrix)
    spread = int(255 / max(1.0, len(palette) ** (1 / 3) - 1)) * scale
    level = _of(((matrix + 1) / (n * n) - 0.5).reshape(-1).tolist(), (F.col("y") % n * n + (F.col("x") - left) % n).cast("int"))
    moved = {c: F.least(F.lit(255.0), F.greatest(F.lit(0.0), F.floor(F.col(c) + spread * level + 0.5).cast("double"))).cast("int") for c in "rgb"}
    return quantize(px.withColumns(moved), palette)


def _ordered_sql(source, palette, size: int = 8, scale: float = 1.0, left: int = 0):
    n = len(bayer(size))
    spread = int(255 / max(1.0, len(palette) ** (1 / 3) - 1))
    t = (bayer(size) + 1) / (n * n) - 0.5
    cells = "(" + " UNION ALL ".join(f"SELECT {i} AS cell, {num(v)} AS t" for i, v in enumerate(t.reshape(-1))) + ")"
    moved = ", ".join(f"CAST(least(255e0, greatest(0e0, floor(v.{c} + {num(spread * scale)} * m.t + 0.5e0))) AS INT) AS {c}" for c in "rgb")
    return _quantize_sql(f"(SELECT v.image_id, v.frame_no, v.y, v.x, {moved}, v.a FROM {source} AS v JOIN {cells} AS m ON m.cell = (v.y % {n}) * {n} + ((v.x - {left}) % {n}))", palette)


ordered_dither.sql = _ordered_sql
