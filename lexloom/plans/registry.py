"""All queries of the core by name."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from lexloom.plans import io, judging, nested, patterns, relational, retrieval, scalars

#: Name of the query that stands for the engine.
FLAGSHIP = "ranked_clauses"

_MODULES = (io, judging, nested, patterns, relational, retrieval, scalars)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for m in _MODULES for name, f in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for m in _MODULES for name, sql in m.SQL.items()}
