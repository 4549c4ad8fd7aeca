"""All queries of the document-compliance engine, with DuckDB SQL for each that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .plans import compliance, document_queries, flagship, manual_queries, narrative, review_queries, stream_queries, vector_queries

MODULES = (compliance, document_queries, manual_queries, narrative, review_queries, vector_queries, stream_queries, flagship)
FLAGSHIP = flagship.flagship_review


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: query for module in MODULES for name, (query, _) in module.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for module in MODULES for name, (_, sql) in module.QUERIES.items() if sql}
