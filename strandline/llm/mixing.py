"""Mixing sources to target weights by entropy balancing.

Rates of documents are tilted exponentially by their size so that each source's expected words meet its target: of
all rates with those totals they have the least entropy relative to one copy each. With rates held below a cap the
odds are tilted, r / (cap - r) = odds_0 * exp(lambda_s * z), and the convex dual has one variable per source, which
Newton steps solve. Documents of one source and size are alike, so all sums run over the (source, size) histogram.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import stage

#: Words as runs of characters other than space and 0x09-0x0D.
WORD = r"[^\x20\x09-\x0D]+"


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)).cast("bigint"), F.lit(0).cast("bigint"))


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = (3, 1, 2), share: float = 1.5, cap: float = 2.0, most_sources: int = 100_000) -> pd.DataFrame:
    """Per source (by code point, null last) its size, weight and target.

    A source's target is proportional to its weight, up to cap times its size; what is cut off goes to the others by
    weight, which in the end is one common level per weight. One row per source is the model's dimension and comes to the
    driver; ValueError beyond most_sources.
    """
    rows = sizes.groupBy("source").agg(F.sum("size").alias("source_size")).limit(most_sources + 1).toPandas()
    if len(rows) > most_sources:
        raise ValueError(f"more than {most_sources} sources")
    rows["_key"] = [(s is None, "" if s is None else s.encode("utf-32-be")) for s in rows["source"]]
    rows = rows.sort_values("_key", ignore_index=True).drop(columns="_key")
    size = rows["source_size"].to_numpy(float)
    weight = np.resize(np.array(weights, float), len(rows))
    limit, target, open_ = cap * size, np.zeros(len(rows)), np.ones(len(rows), bool)
    rest = share * size.sum()
    while open_.any():
        even = np.where(open_, weight * rest / weight[open_].sum(), 0.0)
        over = open_ & (even > limit)
        if not over.any():
            target[open_] = even[open_]
            break
        target[over] = limit[over]
        rest -= limit[over].sum()
        open_ &= ~over
    return rows.assign(weight=weight, target=target)


def balance(histogram: DataFrame, sources: pd.DataFrame, cap: float = 2.0, tolerance: float = 1e-9, most_steps: int = 60) -> pd.DataFrame:
    """The dual variable of each source, by Newton steps on sums that Spark takes over the histogram.

    z = size / mean size of the source. Steps that leave the bracket of a root are halved into it; a target of 0 or
    of the whole cap gets an infinite variable.
    """
    spark = histogram.sparkSession
    state = sources.assign(tilt=0.0, low=-np.inf, high=np.inf)
    full, none = state["target"] >= cap * state["source_size"] * (1 - 1e-12), state["target"] <= 0
    state.loc[full, "tilt"], state.loc[none, "tilt"] = np.inf, -np.inf
    live = ~(full | none)
    for _ in range(most_steps):
        if not live.any():
            break
        now = spark.createDataFrame([(None if s is None else str(s), s is None, float(t)) for s, t in state.loc[live, ["source", "tilt"]].itertuples(index=False)], "source string, _null boolean, tilt double")
        rate = cap / (1 + (cap - 1) * F.exp(-F.least(F.greatest(F.col("tilt") * F.col("z"), F.lit(-700.0)), F.lit(700.0))))
        sums = (
            histogram.join(now.withColumnRenamed("source", "_source"), F.col("source").eqNullSafe(F.col("_source")))
            .withColumn("rate", rate)
            .groupBy("source")
            .agg(F.sum(F.col("n") * F.col("size") * F.col("rate")).alias("got"), F.sum(F.col("n") * F.col("size") * F.col("z") * F.col("rate") * (1 - F.col("rate") / cap)).alias("slope"))
            .toPandas()
        )
        by = {None if pd.isna(s) else s: (g, d) for s, g, d in sums.itertuples(index=False)}
        for k in np.flatnonzero(live):
            got, slope = by[None if pd.isna(state.at[k, "source"]) else state.at[k, "source"]]
            miss, tilt = got - state.at[k, "target"], state.at[k, "tilt"]
            if abs(miss) <= tolerance * state.at[k, "target"] + 1e-6:
                live[k] = False
                continue
            state.at[k, "high" if miss > 0 else "low"] = tilt
            low, high = state.at[k, "low"], state.at[k, "high"]
            step = tilt - miss / slope if slope > 0 else math.nan
            if not low < step < high:
                step = (low + high) / 2 if math.isfinite(low + high) else (2 * tilt + 1 if math.isinf(high) else 2 * tilt - 1)
            state.at[k, "tilt"] = step
    return state


def _diffuse(rows: pd.DataFrame, cap: float) -> pd.DataFrame:
    """Whole copies for each size of a source, from the largest down; what rounding leaves is carried to the next size."""
    rows = rows.sort_values("size", ascending=False, ignore_index=True)
    copies, carry, most = np.zeros(len(rows), np.int64), 0.0, int(cap)
    for k, (size, n, rate) in enumerate(rows[["size", "n", "rate"]].itertuples(index=False)):
        if size == 0:
            copies[k] = n
            continue
        want = n * rate * size + carry
        copies[k] = min(max(round(want / size), 0), most * n)
        carry = want - copies[k] * size
    return rows.assign(copies=copies)[["source", "size", "n", "copies"]]


def mix(docs: DataFrame, weights: tuple[int, ...] = (3, 1, 2), share: float = 1.5, cap: int = 2, bucket_rows: int = 1000, text: str = "text", id_col: str = "doc_id", row_hash: bool = False) -> DataFrame:
    """Per row of docs: id, source, size, source_size, target (of its source), copies and taken (= copies * size); with row_hash also xxhash64(id, text).

    `cap` is the most copies of a document. Within a source and size the extra copies go to the rows with the smallest
    hash of (id, text), ranked inside hash buckets of about bucket_rows rows whose counts are summed before, so a size
    that a third of all rows has is never sorted in one task. Equal rows may differ in copies by one. Null texts have
    size 0, are kept once and take no words; null source is the last source; reruns agree; empty tables give none.
    """
    rows = stage(docs.select(id_col, F.col("source").cast("string").alias("source"), word_count(F.col(text)).alias("size"), F.xxhash64(id_col, text).alias("_hash")), "sizes")
    counts = rows.groupBy("source", "size").agg(F.count("*").alias("n"))
    histogram = stage(counts, "histogram")
    sources = source_targets(histogram.select("source", (F.col("size") * F.col("n")).alias("size")), weights, share, cap)
    means = histogram.groupBy("source").agg((F.sum(F.col("size") * F.col("n")) / F.sum("n")).alias("mean"), F.sum(F.col("size") * F.col("n")).alias("source_size"))
    scaled = histogram.join(means.withColumnRenamed("source", "_source"), F.col("source").eqNullSafe(F.col("_source"))).select("source", "size", "n", (F.col("size") / F.greatest(F.col("mean"), F.lit(1.0))).alias("z"))
    scaled = stage(scaled, "scaled")
    state = balance(scaled, sources, cap)
    spark = docs.sparkSession
    solved = spark.createDataFrame([(None if pd.isna(r.source) else r.source, int(r.source_size), float(r.target), float(np.clip(r.tilt, -1e300, 1e300))) for r in state.itertuples(index=False)], "_source string, source_size bigint, target double, tilt double")
    rate = cap / (1 + (cap - 1) * F.exp(-F.least(F.greatest(F.col("tilt") * F.col("z"), F.lit(-700.0)), F.lit(700.0))))
    by_size = scaled.join(solved, F.col("source").eqNullSafe(F.col("_source"))).withColumn("rate", rate)
    rounded = by_size.groupBy("source").applyInPandas(lambda rows: _diffuse(rows, cap), "source string, size bigint, n bigint, copies bigint")
    rounded = stage(rounded.join(solved, F.col("source").eqNullSafe(F.col("_source"))).select(F.col("source").alias("_source"), F.col("size").alias("_size"), "n", "source_size", "target", (F.col("copies") / F.col("n")).cast("bigint").alias("_each"), (F.col("copies") % F.col("n")).alias("_more")), "rounded")
    same = F.col("source").eqNullSafe(F.col("_source")) & (F.col("size") == F.col("_size"))
    dealt = rows.join(rounded, same).withColumn("_bucket", F.floor((F.col("_hash") / 2.0**64 + 0.5) * F.ceil(F.col("n") / bucket_rows)))
    dealt = stage(dealt, "dealt")
    held = dealt.where("_more > 0").groupBy("_source", "_size", "_bucket").agg(F.count("*").alias("_count"))
    upto = Window.partitionBy("_source", "_size").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    before = held.select(F.col("_source").alias("_s"), F.col("_size").alias("_z"), F.col("_bucket").alias("_b"), F.coalesce(F.sum("_count").over(upto), F.lit(0)).alias("_before"))
    key = F.col("_source").eqNullSafe(F.col("_s")) & (F.col("_size") == F.col("_z")) & (F.col("_bucket") == F.col("_b"))
    rank = F.row_number().over(Window.partitionBy("_source", "_size", "_bucket").orderBy("_hash", id_col))
    extra = dealt.where("_more > 0").withColumn("_rank", rank).join(before, key).withColumn("copies", F.col("_each") + (F.col("_before") + F.col("_rank") <= F.col("_more")).cast("bigint"))
    out = [id_col, "source", "size", "source_size", "target", "copies", *[F.col("_hash").alias("row_hash")] * row_hash]
    done = extra.select(*out).unionByName(dealt.where("_more = 0").withColumn("copies", F.col("_each")).select(*out))
    return done.withColumn("taken", F.col("copies") * F.col("size"))
