"""Registry of named queries and their DuckDB oracle SQL.

``@register(name, sql)`` records a query ``fn(spark, sf_dir) -> DataFrame``
and, when the work is SQL-expressible, the SQL that DuckDB runs on the same
parquet tables (registered as views named like the files).
"""

from __future__ import annotations

from collections.abc import Callable

QUERIES: dict[str, Callable] = {}
ORACLE: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def deco(fn):
        if name in QUERIES:
            raise ValueError(f"query {name!r} registered twice")
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn
    return deco


def _load_all():
    # Importing the modules fills the registry.
    from . import (boundary_queries, choice_queries, sketch_queries, curation_queries, feature_queries, evaluation_queries,  # noqa: F401
                   joint_queries, serving_queries, stream_queries)


def queries() -> dict[str, Callable]:
    _load_all()
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    _load_all()
    return dict(ORACLE)
