"""Operators for training-data pipelines: tokens, quality, neighbours, duplicates, archives, mixing, packing.

One module per operator, ``queries.py`` registers them. Nothing outside this package imports it.
"""
