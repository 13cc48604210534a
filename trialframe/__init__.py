"""Spark DataFrame operators for trial-structured point events."""
