"""Patches that arrive as a stream."""
