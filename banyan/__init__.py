"""Spark-native analytics for knowledge graphs, retrieval and entity data."""
