"""Readers and adapters that turn files and tables into tokens, items and sequences."""
