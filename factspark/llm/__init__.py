"""Operators of a training-data pipeline: formatting, cleaning, dedup, scoring, tokenising.

Nothing outside this subpackage imports it.  Every operator is a function from
DataFrames to a DataFrame; ``queries.py`` binds the operators to the tables of
a folder and derives the digest columns of the registered queries.
"""
