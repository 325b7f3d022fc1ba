"""Spark-native answer-concentration analytics."""
