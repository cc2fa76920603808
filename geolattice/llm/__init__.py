"""Operators for preparing training text: each module holds one, as a function from DataFrames to DataFrames."""
