"""Operators on sequences, patterns and contingency tables; all take and return DataFrames."""
