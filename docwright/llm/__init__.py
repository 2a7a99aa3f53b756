"""Operators for training data. Nothing outside this package imports it."""

from .queries import oracle_sql, queries

__all__ = ["oracle_sql", "queries"]
