"""Raster analytics on Spark: images as DataFrames, operators as lazily evaluated transformations."""
