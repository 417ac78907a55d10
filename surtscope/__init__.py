"""Spark-native analytics over web-archive capture indexes."""

__version__ = "0.1.0"
