"""Code and text search operators on Spark DataFrames."""
