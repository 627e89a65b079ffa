"""Operators for preparing training data: sharding, formatting, deduplication, tokenising, packing, search.

Nothing outside this package imports it.
"""
