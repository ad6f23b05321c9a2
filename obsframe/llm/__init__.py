"""Operators for training text: duplicates, contamination, quality, personal data, tokens, archives."""
