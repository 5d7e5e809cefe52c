"""Queries as data: syntax trees, parsing and validation, compilation to DataFrames."""
