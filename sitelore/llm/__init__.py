"""Operators for building training data: dedup, packing, scoring, mixing, search, archives."""
