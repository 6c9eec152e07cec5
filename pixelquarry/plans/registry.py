"""Queries of the raster engine and their DuckDB twins."""

from __future__ import annotations

from . import rasters
from .color_queries import COLORS
from .frame_queries import FRAMES
from .px_queries import PX
from .source_queries import SOURCES

_ALL = PX | FRAMES | COLORS | SOURCES


def _px(name):
    run, _ = _ALL[name]
    return lambda spark, sf_dir: run(rasters.events_px(spark, sf_dir))


def queries():
    return {name: _px(name) for name in _ALL}


def oracle_sql():
    return {name: f"WITH px AS {rasters.events_sql()} {text('px')}" for name, (_, text) in _ALL.items() if text is not None}


def flagship(spark, sf_dir):
    return queries()["equalized_statistics"](spark, sf_dir)
