"""Operators for training data: near-duplicates, split overlap, encoding, leakage and language labels."""
