"""Operators of a training-data pipeline: fingerprints, filters, dedup, mixing, packing, WARC.

Nothing else in the library imports this package; ``catalog`` holds its registered queries.
"""
