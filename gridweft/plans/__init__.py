"""Rasters and lazily merged trees of them."""
