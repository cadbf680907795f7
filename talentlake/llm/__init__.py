"""Operators for preparing training text: packing, dedup, sharding, tokens, language, quality, HTML."""
