"""Spark-native analytics for large tables of barcode records."""
