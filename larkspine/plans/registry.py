"""Registered queries for the retrieval operators, by their identifiers, and SQL that DuckDB answers alike.

Searches take as queries every row whose id is divisible by 100.
"""

from __future__ import annotations

from larkspine.plans import queries_composed, queries_functions, queries_index, queries_retrieval, queries_sql, queries_stores
from larkspine.plans.base import QUERIES, SQL

__all__ = ["QUERIES", "SQL", "queries_composed", "queries_functions", "queries_index", "queries_retrieval", "queries_sql", "queries_stores"]
