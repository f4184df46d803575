"""A Spark-native web-content analytics engine."""
