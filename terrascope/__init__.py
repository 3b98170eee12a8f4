"""Semantic-map analytics on Spark: every operator is a DataFrame -> DataFrame function."""

__version__ = "0.1.0"
