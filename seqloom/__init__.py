"""Seqloom: sequence-pattern and contingency analytics on Spark DataFrames."""
