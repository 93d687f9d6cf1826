"""Operators for training-data pipelines: filters, scans, search, deduplication and mixing."""
