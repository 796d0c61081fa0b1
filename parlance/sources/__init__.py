"""Readers, writers and the binding of analytics concepts to stored tables."""
