"""All registered queries of the library."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from orefield.plans import analysis_queries, embedding_queries, extract_queries, function_queries, graph_queries, learning_queries, linear_queries, resolve_queries, sink_queries

MODULES = [function_queries, graph_queries, resolve_queries, analysis_queries, embedding_queries, extract_queries, learning_queries, linear_queries, sink_queries]


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for m in MODULES for name, f in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for m in MODULES for name, sql in m.ORACLE_SQL.items()}
