"""Operators for training-data corpora: counting, filtering, near-duplicates, packing."""
