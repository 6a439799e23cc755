"""Operators for building training data out of code and text. Nothing else in the library imports this package."""
