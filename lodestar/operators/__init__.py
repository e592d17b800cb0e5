"""Operators on DataFrames keyed by sample."""
