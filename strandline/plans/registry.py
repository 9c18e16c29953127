"""Registered queries by name, and their SQL twins."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
MODULES = ["scalar_queries", "structure_queries", "region_queries", "graph_queries", "functional_queries", "verification_queries", "plain_queries", "record_queries", "text_queries", "store_queries"]


def query(sql: str | None = None) -> Callable:
    """Registers a function of (spark, sf_dir) under its own name."""

    def register(f: Callable[[SparkSession, str], DataFrame]) -> Callable:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return register


def _load() -> None:
    for m in MODULES:
        importlib.import_module(f"strandline.plans.{m}")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    _load()
    return dict(QUERIES)


def whole(sql: str) -> str:
    """The same rows, made before they are read: a LIMIT around some joins keeps DuckDB from
    ending, even one above the number of rows, but not around a table that is made first."""
    return f"WITH result AS MATERIALIZED ({sql.strip()}) SELECT * FROM result"


def oracle_sql() -> dict[str, str]:
    _load()
    return {name: whole(sql) for name, sql in SQL.items()}
