"""Gridweft: multi-resolution raster analytics as Spark DataFrames."""
