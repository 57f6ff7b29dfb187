"""Spark-first engine for exact and near-duplicate content analytics."""
