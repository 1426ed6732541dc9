"""Spark-native text and file analytics."""
