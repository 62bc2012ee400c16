"""Operators of a training-data pipeline: classifiers, near-duplicates, mixing, packing, search."""
