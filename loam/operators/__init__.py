"""Operators: each takes a DataFrame and returns one, for use with ``DataFrame.transform``."""
