"""All registered queries of the graph and their SQL."""

from __future__ import annotations

from . import candidates_sql, extended_sql, landed_sql, network_sql, oracles, queries, whole_sql

QUERIES = queries.QUERIES
SQL: dict[str, str] = oracles.SQL | landed_sql.SQL | extended_sql.SQL | network_sql.SQL | whole_sql.SQL | candidates_sql.SQL
