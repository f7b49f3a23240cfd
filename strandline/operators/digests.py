"""Digests of whole tables that don't depend on order or partitioning, in one pass without a sort."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_CHUNKS = 4


def row_text(columns: list[str]) -> Column:
    """A row as JSON with its nulls, the same for equal rows."""
    return F.to_json(F.struct(*(F.col(f"`{c}`").alias(c) for c in columns)), {"ignoreNullFields": "false"})


def multiset_digest(df: DataFrame, item: Column, *by: str) -> DataFrame:
    """(by, rows, digest): SHA-256 of the number of rows and the exact sums of the four quarters of each row's SHA-256.

    Sums are combined before the shuffle, and rows that repeat count as often as they occur; a changed, lost or added row changes the
    digest. A null item is as an empty one. Without rows there is one digest, of nothing, unless `by` is given.
    """
    hashed = df.select(*by, F.sha2(F.coalesce(item, F.lit("")).cast("binary"), 256).alias("_h"))
    quarter = lambda k: F.conv(F.substring("_h", 16 * k + 1, 16), 16, 10).cast("decimal(20,0)")
    sums = [F.coalesce(F.sum(quarter(k)).cast("decimal(38,0)"), F.lit(0).cast("decimal(38,0)")).cast("string").alias(f"_s{k}") for k in range(_CHUNKS)]
    counted = hashed.groupBy(*by).agg(F.count("*").alias("rows"), *sums) if by else hashed.agg(F.count("*").alias("rows"), *sums)
    return counted.select(*by, "rows", F.sha2(F.concat_ws(",", F.col("rows").cast("string"), *(f"_s{k}" for k in range(_CHUNKS))), 256).alias("digest"))
