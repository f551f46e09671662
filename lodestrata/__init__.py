"""Spark-native hybrid retrieval and knowledge-index engine."""

__version__ = "0.1.0"
