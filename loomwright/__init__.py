"""Spark-native analytics for long-form text."""

__version__ = "0.1.0"
