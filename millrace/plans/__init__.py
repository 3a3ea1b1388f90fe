"""Registered queries: one per operator, with its SQL check where SQL can express it."""

from .registry import oracle_sql, queries

__all__ = ["oracle_sql", "queries"]
