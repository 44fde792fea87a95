"""Operators for training data: near-duplicates, term counts, packing, mixing and cutting of texts."""
