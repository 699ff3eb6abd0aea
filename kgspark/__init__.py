"""Spark-native analytics over evidence-backed knowledge graphs."""
