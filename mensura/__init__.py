"""Spark-native analytics for measurement data mined from scientific papers."""
