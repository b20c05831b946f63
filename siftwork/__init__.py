"""Spark-native engine for sensitive-data detection, release checks and privacy scoring."""
