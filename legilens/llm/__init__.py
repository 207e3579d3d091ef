"""Operators for preparing large text corpora: deduplication, filtering, mixing, tokenising and search."""
