"""Operators for preparing training data: sharding, search, packing, dedup, scoring, extraction, formatting."""
