"""Batch operators: each function takes and returns DataFrames."""
