"""Operators for training-data corpora: dedup, filters, token counts, mixing, packing, search, quality."""
