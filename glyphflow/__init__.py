"""Spark-native analytics over text-detection and text-recognition output."""

__version__ = "0.1.0"
