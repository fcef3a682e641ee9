"""Operators that prepare training data: deduplication, tokens, language, quality, secrets and mixing.

Nothing outside this folder imports it. Every operator takes and returns DataFrames, reads whole
texts and names its columns by parameter; the thin ``opN_*`` queries are in ``queries.py``.
"""
