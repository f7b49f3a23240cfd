"""All queries over the test tables, with the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import check_queries, event_queries, feature_queries, governance_queries, metric_queries, sequence_queries

_GROUPS = (sequence_queries, check_queries, metric_queries, event_queries, governance_queries, feature_queries)


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sequence_queries.flagship(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: fn for group in _GROUPS for name, (fn, _) in group.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for group in _GROUPS for name, (_, sql) in group.QUERIES.items() if sql}
