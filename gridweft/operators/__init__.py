"""Spatial filters, overlays, point sampling, layer algebra and introspection."""
