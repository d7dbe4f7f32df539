"""Spark-first analytics over time-aligned events, signals and timed text."""
