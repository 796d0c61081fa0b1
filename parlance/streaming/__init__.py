"""The batch operators that also run on streams."""
