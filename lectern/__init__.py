"""Spark-native analytics for scholarly documents and libraries."""

__version__ = "0.1.0"
