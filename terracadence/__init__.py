"""Spark-native analytics over per-entity observation time series."""
