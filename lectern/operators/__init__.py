"""Operators: each maps DataFrames to a DataFrame, lazily, for all books at once."""
