"""Functions for SQL users."""

from __future__ import annotations

from pyspark.sql import SparkSession


def register_time_grid(spark: SparkSession, name: str = "time_grid") -> None:
    """A temporary SQL table function name(span_us, num, den): nominal times of the rate num/den within [0, span], half up, and the exact end. Each row makes its own times: the function joins and broadcasts nothing."""
    spark.sql(f"""
        CREATE OR REPLACE TEMPORARY FUNCTION {name}(span_us BIGINT, num BIGINT, den BIGINT) RETURNS TABLE (grid_us BIGINT)
        RETURN SELECT explode(array_distinct(array_append(filter(transform(sequence(0L, (span_us * num) div (1000000L * den)), i -> (2 * i * 1000000L * den + num) div (2 * num)), t -> t <= span_us), span_us)))""")
