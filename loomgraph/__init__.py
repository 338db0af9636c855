"""Spark-first graph sampling analytics."""
