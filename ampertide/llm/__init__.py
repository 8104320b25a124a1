"""Operators of a training-data pipeline: archives, tokens, models, search, duplicates, packing."""
