"""Scalar functions on patterns, and the similarity of two of them."""
