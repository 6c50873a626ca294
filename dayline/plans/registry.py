"""All registered queries and their SQL, by module."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from dayline.plans import calendar_queries, device_queries, function_queries, marker_queries, pipeline_queries, retrieval_queries, source_queries, state_queries, stats_queries, stream_queries

MODULES = [pipeline_queries, marker_queries, stats_queries, retrieval_queries, calendar_queries, state_queries, device_queries, source_queries, function_queries, stream_queries]


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: v for m in MODULES for k, v in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {k: v for m in MODULES for k, v in m.SQL.items()}
