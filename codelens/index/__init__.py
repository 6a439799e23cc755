"""The positional gram index, as tables."""
