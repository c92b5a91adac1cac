"""Operators for preparing training corpora; see :mod:`siftwell.llm.registry`."""

from siftwell.llm.registry import oracle_sql, queries

__all__ = ["oracle_sql", "queries"]
