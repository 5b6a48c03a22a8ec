"""The named queries and their DuckDB equivalents, gathered from the modules beside this one."""

from __future__ import annotations

from . import queries_audit, queries_categories, queries_ingest, queries_reads, queries_series

MODULES = (queries_ingest, queries_categories, queries_reads, queries_series, queries_audit)


def queries() -> dict:
    return {name: query for module in MODULES for name, query in module.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for module in MODULES for name, sql in module.ORACLES.items()}
