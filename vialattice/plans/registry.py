"""All queries over the driver's tables and the SQL that they are compared with."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import assign_queries, generate_queries, lane_queries, learning_queries, match_queries, pseudo_queries, stream_queries

FAMILIES = (assign_queries, lane_queries, match_queries, generate_queries, pseudo_queries, stream_queries, learning_queries)
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {k: q for m in FAMILIES for k, q in m.QUERIES.items()}
ORACLE_SQL: dict[str, str] = {k: s for m in FAMILIES for k, s in m.ORACLE_SQL.items()}
