"""Spark-native engine over temporal facts, graphs, text and retrieval."""
