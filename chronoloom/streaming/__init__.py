"""Structured Streaming variants of the windowed operators."""
