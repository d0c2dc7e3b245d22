"""Spark-native dataset curation and evaluation engine."""
