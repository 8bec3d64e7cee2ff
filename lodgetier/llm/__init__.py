"""Operators for preparing training data: mixing, near and exact duplicates, tokens, scoring, search, sharding."""
