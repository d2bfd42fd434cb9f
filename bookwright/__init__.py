"""Spark-native engine that turns document collections into searchable chunks."""
