"""Spark-native retrieval and evidence analytics over DataFrames, Spark SQL and Structured Streaming."""

__version__ = "0.1.0"
