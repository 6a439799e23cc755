"""Operators of the search engine on DataFrames."""
