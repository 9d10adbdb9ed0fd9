"""Spark-native data-quality engine: profile, detect, review, apply, export."""
