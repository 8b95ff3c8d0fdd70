"""Named queries over the test tables, each with the SQL that DuckDB checks it by."""

from __future__ import annotations

from kinloom.plans import linkage_queries, registry, service_queries, text_queries  # noqa: F401  registers


def queries():
    return dict(registry.QUERIES)


def oracle_sql():
    return dict(registry.SQL)
