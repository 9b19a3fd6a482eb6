"""Operators: pure functions from DataFrames to DataFrames. Nothing here collects."""
