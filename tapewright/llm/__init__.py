"""Operators for preparing text corpora: tokenizing, deduplication, extraction, scoring, search and sharding."""
