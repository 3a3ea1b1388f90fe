"""Operators of a training-data pipeline, and their registered queries."""

from .queries import oracle_sql, queries

__all__ = ["oracle_sql", "queries"]
