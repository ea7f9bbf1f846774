"""Relational operators of retrieval, on DataFrames."""
