"""Operators that prepare training text: filters, deduplication, extraction, mixing, tokens, vector search."""
