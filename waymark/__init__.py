"""Spark-first resolution of noisy address-like text against register data."""
