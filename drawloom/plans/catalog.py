"""The queries over the driver tables, each with its SQL where SQL can express it."""

from __future__ import annotations

from drawloom.plans import annotate_queries, diff_queries, model_queries, result_queries, scan_queries, scope_queries, sync_queries

QUERIES: dict = {}
SQL: dict[str, str] = {}
for _module in (scan_queries, diff_queries, scope_queries, annotate_queries, sync_queries, result_queries, model_queries):
    QUERIES |= _module.QUERIES.functions
    SQL |= _module.QUERIES.sql
