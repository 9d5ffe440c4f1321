"""Operators on bars, trades and logs: DataFrames in, DataFrames out."""
