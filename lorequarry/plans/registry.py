"""All queries of the engine by name, each with the SQL that gives the same rows where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from lorequarry.plans import commit_queries, context_queries, document_queries, relational_queries, search_queries, service_queries, stream_queries

Query = Callable[[SparkSession, str], DataFrame]
ALL = relational_queries.QUERIES | search_queries.QUERIES | context_queries.QUERIES | document_queries.QUERIES | service_queries.QUERIES | stream_queries.QUERIES | commit_queries.QUERIES
flagship: Query = context_queries.flagship


def queries() -> dict[str, Query]:
    return {name: query for name, (query, _) in ALL.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, (_, sql) in ALL.items() if sql}
