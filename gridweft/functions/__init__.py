"""Column expressions and driver-side scalars on cells, boxes and layer values."""
