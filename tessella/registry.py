"""All registered queries of the matrix, graph and statistics operators, and their SQL."""

from __future__ import annotations

from .plans import graph_queries, matrix_queries, more_queries, signature_queries, stats_queries  # noqa: F401
from .plans.base import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES"]
