"""Spark-native clinical case-log analytics."""

__version__ = "0.1.0"
