"""Operators for preparing large text collections for model training.

Nothing outside this subpackage imports it.  Each operator module offers a general
interface over DataFrames; ``queries`` holds the thin registered queries.
"""
