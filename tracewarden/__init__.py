"""Spark-native evidence and detection analytics."""
