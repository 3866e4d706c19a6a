"""Operators: DataFrames in, one DataFrame out, no action inside."""
