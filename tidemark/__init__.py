"""Tidemark: a Spark-native analytics engine for event-sourced contact data."""

__version__ = "0.1.0"
