"""Operators of a training-data pipeline: extraction, scoring, mixing, deduplication, formatting and encoding."""
