"""Operators on DataFrames, keyed by columns."""
