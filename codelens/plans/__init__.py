"""Queries as Spark plans."""
