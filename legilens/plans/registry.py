"""All registered queries and their SQL."""

from __future__ import annotations

from legilens.plans import engine_queries, scalar_queries

QUERIES = scalar_queries.QUERIES | engine_queries.QUERIES
SQL: dict[str, str] = scalar_queries.SQL | engine_queries.SQL
