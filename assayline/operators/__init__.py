"""Operators: each maps DataFrames to a DataFrame."""
