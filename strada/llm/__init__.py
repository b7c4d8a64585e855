"""Operators of a training-data pipeline: deduplication, filters, mixing, tokens.

Nothing outside this subpackage imports it; it can be removed as a whole.
"""
