"""Similarity joins and rankings over DataFrames."""
