"""The queries of the core: (spark, directory) -> DataFrame, each with SQL for the same result where SQL has it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .plans import attempt_queries, case_queries, golden_queries, graph_queries, report_queries, routine_queries, search_queries, state_queries, stream_queries, table_queries

_PARTS = [search_queries, attempt_queries, state_queries, graph_queries, table_queries, routine_queries, case_queries, report_queries, golden_queries, stream_queries]

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {k: f for p in _PARTS for k, f in p.QUERIES.items()}
SQL: dict[str, str] = {k: q for p in _PARTS for k, q in p.SQL.items()}
