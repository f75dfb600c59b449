"""Operators for building training corpora: archives, deduplication, tokens, screening, search and sharding."""
