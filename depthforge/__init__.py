"""Spark-native analytics for limit-order-book data."""
