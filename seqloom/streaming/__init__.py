"""Sequences from streams."""
