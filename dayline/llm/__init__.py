"""Operators for large training corpora: deduplication, scoring, tokens, mixing, sharding, extraction."""
