"""Operators for training-data pipelines: packing, sharding, tokenising, near duplicates, filters, chat formatting."""
