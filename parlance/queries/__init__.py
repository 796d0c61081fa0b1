"""Registered queries, each beside the DuckDB SQL it must equal."""

from . import decisions, evaluation, governance, profile, retrieval, sampling, scans, text, threads  # noqa: F401
