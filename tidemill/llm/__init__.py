"""Operators for training-data text: deduplication, filtering, tokens and scoring."""
