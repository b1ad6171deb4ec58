"""Spark-native analytics for unsynchronised spatial sensor recordings."""
