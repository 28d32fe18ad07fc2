"""All queries of the core, by name."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import corpus, language, memorization, packing, similarity, tracking

_FAMILIES = (corpus.QUERIES, language.QUERIES, packing.QUERIES, similarity.QUERIES, memorization.QUERIES, tracking.QUERIES)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    """Each query takes the session and a folder of tables."""
    return {name: query for family in _FAMILIES for name, (query, _) in family.items()}


def oracle_sql() -> dict[str, str]:
    """DuckDB SQL with the same rows, for the queries that SQL can express over whole tables."""
    return {name: sql for family in _FAMILIES for name, (_, sql) in family.items() if sql}
