"""Datalog over DataFrames: facts, queries, rules, pull and transactions on Spark."""
