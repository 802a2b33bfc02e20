"""Every registered query and, where SQL can express it, its DuckDB SQL."""

from __future__ import annotations

from ledgerloom.plans import analytics_queries, cache_queries, export_queries, picture_queries, scoring_queries, service_queries, text_queries

_PARTS = (analytics_queries, scoring_queries, text_queries, export_queries, cache_queries, service_queries, picture_queries)

QUERIES = {name: f for part in _PARTS for name, f in part.QUERIES.items()}
ORACLE_SQL = {name: sql for part in _PARTS for name, sql in part.SQL.items()}
