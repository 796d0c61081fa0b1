"""Column to Column helpers."""
