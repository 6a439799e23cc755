"""The query language: text to a normalised tree of terms (driver side only)."""
