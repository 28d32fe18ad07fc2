"""Corpus analytics on Spark: splits, deduplication, leakage, memorization, packing and experiment tracking."""
