"""Semantic queries on Spark."""
