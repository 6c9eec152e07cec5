"""SQL expressions that Spark and DuckDB read alike, and operators written with them.

An operator is a function from a relation's name to a query over it. Called with
a DataFrame it is a lazily planned DataFrame (Catalyst sees plain SQL); called
with a name, its text can be nested in the text of the next one.
"""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame

KEYS = "image_id, frame_no, y, x"


def num(v: float) -> str:
    """A double literal in either dialect; without an exponent they'd be decimals."""
    m, e = f"{float(v):.17e}".split("e")
    short = repr(float(v))
    return f"({short}e0)" if "e" not in short and short not in ("inf", "-inf", "nan") else f"({m}e{int(e)})"


def scaled(c: str) -> str:
    """A byte channel as a double from 0 to 1."""
    return f"({c} / 255e0)"


def clamp(v: str, low: str = "0e0", high: str = "1e0") -> str:
    return f"least({high}, greatest({low}, {v}))"


def pack(v: str) -> str:
    """0..1 to a byte: clamp, scale, add a half, cut."""
    return f"CAST(floor(255e0 * {clamp(v)} + 0.5e0) AS INT)"


def half_even(v: str) -> str:
    """Round to the nearest whole number, ties to the even one."""
    return f"(floor({v}) + CASE WHEN ({v}) - floor({v}) > 0.5e0 OR (({v}) - floor({v}) = 0.5e0 AND CAST(floor({v}) AS BIGINT) % 2 <> 0) THEN 1e0 ELSE 0e0 END)"


def luma8(r: str = "r", g: str = "g", b: str = "b") -> str:
    """8-bit luminance of byte channels."""
    return f"CAST(floor(0.2126e0 * {r} + 0.7152e0 * {g} + 0.0722e0 * {b} + 0.5e0) AS INT)"


def luma(r: str, g: str, b: str) -> str:
    """Luminance of scaled channels."""
    return f"(0.2126e0 * {r} + 0.7152e0 * {g} + 0.0722e0 * {b})"


def inside(rect) -> str:
    """Whether a pixel lies in (x, y, width, height)."""
    x, y, w, h = rect
    return f"(x >= {x} AND x < {x + w} AND y >= {y} AND y < {y + h})"


def within(rect, new: str, old: str) -> str:
    return new if rect is None else f"CASE WHEN {inside(rect)} THEN {new} ELSE {old} END"


def operator(build):
    """build(source, ...) -> SQL. The result takes a DataFrame and gives one; .sql(source, ...) gives the text."""

    @functools.wraps(build)
    def run(px: DataFrame, *args, **kw) -> DataFrame:
        return px.sparkSession.sql(build("{px}", *args, **kw), px=px)

    run.sql = lambda source, *args, **kw: build(source, *args, **kw)
    return run
