"""Spark-native analytics over time-keyed events and intervals."""
