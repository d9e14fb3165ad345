"""Operators for preparing training text: deduplication, filters, packing, sharding, tokens."""
