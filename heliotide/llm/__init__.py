"""Operators for large text corpora: quality, duplicates, repeats, toxicity, secrets, licences, packing.

Nothing outside this package imports it.
"""
