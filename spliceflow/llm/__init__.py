"""Operators of a training-data pipeline: counting, packing, filtering and deduplication of documents."""
