"""Spark-native analytics over file entities."""

__version__ = "0.1.0"
