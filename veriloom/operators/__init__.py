"""Operators: DataFrames and column names in, DataFrames out."""
