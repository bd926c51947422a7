"""Spark-native analytics for multi-channel sampled series."""
