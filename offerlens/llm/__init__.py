"""Operators for building training data: filters, token counts, near copies, shards, archives, extraction."""
