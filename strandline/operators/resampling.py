"""Bootstrap intervals over groups, drawn where the groups are: what is shuffled grows with rounds and buckets, not with groups."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.staging import written


def bucket_draws(sizes: list[int], rounds: int, seed: int, bucket: int) -> np.ndarray:
    """How many of each round's sum(sizes) draws fall into a bucket: binomial splits from all buckets down to it. Both halves of a split see the same draw."""
    low, high = 0, len(sizes)
    left = np.full(rounds, sum(sizes), np.int64)
    while high - low > 1:
        mid = (low + high) // 2
        all_, first = sum(sizes[low:high]), sum(sizes[low:mid])
        drawn = np.random.default_rng([seed, low, high]).binomial(left, first / all_ if all_ else 0.0)
        left, low, high = (drawn, low, mid) if bucket < mid else (left - drawn, mid, high)
    return left


def group_weights(draws: np.ndarray, size: int, seed: int, bucket: int, block: int = 4096) -> Iterator[tuple[int, np.ndarray]]:
    """How often each round draws each of a bucket's groups, a block of groups at a time: (first group, rounds x groups)."""
    rng = np.random.default_rng([seed, 1 << 20, bucket])
    left = draws.copy()
    for start in range(0, size, block):
        n = min(block, size - start)
        own = rng.binomial(left, n / (size - start))
        left -= own
        yield start, rng.multinomial(own, np.full(n, 1 / n))


def bootstrap_ratios(counts: DataFrame, group: str, ratios: dict[str, tuple[str, str]], rounds: int, seed: int, buckets: int = 256) -> DataFrame:
    """(ratio, groups, low, high): 2.5 and 97.5 % nearest ranks of each ratio (sum of hits by sum of total) over rounds that draw whole groups with replacement.

    All ratios see the same draws. Rows are summed by group, groups dealt to buckets by a hash of their id and ordered by it, so draws
    don't depend on partitioning; the driver knows the buckets' sizes only. Each bucket draws its own groups' weights and gives a row for each
    round. Null counts are zero, a round without total has no ratio, and fewer than two groups give NULL bounds. Counts are integers.
    """
    columns = sorted({c for pair in ratios.values() for c in pair})
    order = F.md5(F.coalesce(F.col(group).cast("string"), F.lit("null")).cast("binary"))
    sums = [F.coalesce(F.sum(c), F.lit(0)).cast("bigint").alias(c) for c in columns]
    summed = counts.groupBy(group).agg(*sums).withColumn("_o", order).withColumn("_b", (F.conv(F.substring("_o", 1, 8), 16, 10).cast("bigint") % buckets).cast("int"))
    dealt = written(summed.select("_b", "_o", F.col(group).isNull().alias("_null"), *columns), "bootstrap")
    sizes = [0] * buckets
    for r in dealt.groupBy("_b").agg(F.count("*").alias("n")).collect():
        sizes[r["_b"]] = r["n"]
    n = sum(sizes)
    names = counts.sparkSession.createDataFrame([(k, n) for k in ratios], "ratio string, groups bigint")
    if n < 2:
        return names.select("ratio", "groups", F.lit(None).cast("double").alias("low"), F.lit(None).cast("double").alias("high"))

    def draw(table: pa.Table) -> pa.Table:
        table = table.sort_by([("_o", "ascending"), ("_null", "ascending")])
        bucket = table["_b"][0].as_py()
        values = np.stack([table[c].to_numpy() for c in columns], axis=1)
        total = np.zeros((rounds, len(columns)), np.int64)
        for start, weights in group_weights(bucket_draws(sizes, rounds, seed, bucket), len(values), seed, bucket):
            total += weights @ values[start : start + weights.shape[1]]
        return pa.table({"round": np.arange(rounds), **{c: total[:, k] for k, c in enumerate(columns)}})

    drawn = dealt.groupBy("_b").applyInArrow(draw, "round bigint, " + ", ".join(f"`{c}` bigint" for c in columns))
    by_round = drawn.groupBy("round").agg(*(F.sum(c).alias(c) for c in columns))
    each = by_round.select(F.explode(F.array(*(F.struct(F.lit(k).alias("ratio"), F.when(F.col(t) != 0, F.col(h) / F.col(t)).alias("v")) for k, (h, t) in ratios.items()))).alias("x")).select("x.*")
    bounds = each.groupBy("ratio").agg(F.expr("percentile_disc(0.025) WITHIN GROUP (ORDER BY v)").alias("low"), F.expr("percentile_disc(0.975) WITHIN GROUP (ORDER BY v)").alias("high"))
    return names.join(bounds, "ratio", "left")
