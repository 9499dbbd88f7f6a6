"""Queries over the driver's tables, and the SQL that gives the same rows."""

from __future__ import annotations

from .plans import event_queries, source_queries, table_queries

QUERIES: dict = event_queries.QUERIES | table_queries.QUERIES | source_queries.QUERIES
ORACLE_SQL: dict[str, str] = event_queries.ORACLE_SQL | table_queries.ORACLE_SQL | source_queries.ORACLE_SQL
