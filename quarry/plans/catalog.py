"""Registry of named queries: a Spark builder `(spark, sf_dir) -> DataFrame` and, where the
operator is SQL-expressible, the equivalent DuckDB SQL over the same parquet tables.

Query modules register themselves with `@query(name, sql)`; `__spark_entry__` exposes the
two dictionaries.
"""
from __future__ import annotations

from typing import Callable

from pyspark.sql import DataFrame, SparkSession

QueryFn = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, QueryFn] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def deco(fn: QueryFn) -> QueryFn:
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn
    return deco


MODULES = ["feedback_queries", "training_queries", "knowledge_queries", "document_queries",
           "retrieval_queries", "registry_queries", "mentor_queries", "streaming_queries",
           "generation_queries"]


def load_all() -> None:
    """Import every query module so that all queries are registered."""
    import importlib
    import importlib.util
    for m in MODULES:
        name = f"quarry.plans.{m}"
        if importlib.util.find_spec(name) is not None:
            importlib.import_module(name)
