"""Spark-native audit engine for data-deletion requests."""

__version__ = "0.1.0"
