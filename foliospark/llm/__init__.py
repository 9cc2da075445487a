"""Operators for large text corpora: deduplication, mixing, scoring, filtering, tokenising.

Nothing outside this subpackage imports it.
"""
