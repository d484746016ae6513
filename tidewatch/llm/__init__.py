"""Operators for preparing training text: dedup, scoring, tokens, search, packing, sharding."""
