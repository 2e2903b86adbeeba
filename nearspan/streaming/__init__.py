"""Similarity joins of a stream with a table."""
