"""Spark-native analytics for multi-channel raster and deep-sample data."""
