"""Spark-native research engine for timestamped event tapes."""
