"""Operators for training-data pipelines: search, archives, scoring, cleaning, deduplication, mixing, packing."""
