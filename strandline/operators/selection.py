"""Selection under quotas, aliases, and first usable candidates: ranks inside groups, never a global sort of the facts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.staging import written


def alias(df: DataFrame, column: str, prefix: str, width: int = 3) -> DataFrame:
    """(column, alias): a stable name by the rank among the distinct identities, padded to width; longer ranks stay whole.

    Ranks are taken inside ranges of identities, and each range starts after the counts of those before it; only these counts are sorted as a whole.
    """
    ids = df.select(column).where(F.col(column).isNotNull()).distinct().repartitionByRange(column)
    ranged = written(ids.select(column, F.spark_partition_id().alias("_range")), "alias-ranges")
    before = F.sum("_n").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1))
    starts = ranged.groupBy("_range").agg(F.count("*").alias("_n")).select("_range", F.coalesce(before, F.lit(0)).alias("_start"))
    k = F.row_number().over(Window.partitionBy("_range").orderBy(column))
    ranked = ranged.withColumn("_k", k).join(F.broadcast(starts), "_range").select(column, (F.col("_k") + F.col("_start")).cast("string").alias("_rank"))
    return ranked.select(column, F.concat(F.lit(prefix), F.lpad("_rank", F.greatest(F.lit(width), F.length("_rank")), F.lit("0"))).alias("alias"))


def interleave(df: DataFrame, group: str, *order: str) -> DataFrame:
    """Adds depth: every group's first row comes before any second (sort by depth, group)."""
    return df.withColumn("depth", F.row_number().over(Window.partitionBy(group).orderBy(*order)))


def select_quota(df: DataFrame, quota: int, signer: str, order: tuple[str, ...], *group: str) -> DataFrame:
    """In order, the first row of each distinct signer of a group, up to quota; adds place."""
    first = Window.partitionBy(*group, signer).orderBy(*order)
    once = df.withColumn("_k", F.row_number().over(first)).where("_k = 1").drop("_k")
    return once.withColumn("place", F.row_number().over(Window.partitionBy(*group).orderBy(*order))).where(F.col("place") <= quota)


def quota_shortfall(selected: DataFrame, groups: DataFrame, quota: int, *group: str) -> DataFrame:
    """(group, selected, short) of every group, those without any selected row included."""
    n = selected.groupBy(*group).agg(F.count("*").alias("selected"))
    return groups.select(*group).distinct().join(n, list(group), "left").select(*group, F.coalesce("selected", F.lit(0).cast("bigint")).alias("selected"), (quota - F.coalesce("selected", F.lit(0).cast("bigint"))).alias("short"))


def first_usable(df: DataFrame, usable: Column, most: int, order: tuple[str, ...], key: str, *group: str) -> DataFrame:
    """Per group the first of at most `most` candidates that passes (or NULL), and how many were tried and failed before."""
    ranked = df.withColumn("_k", F.row_number().over(Window.partitionBy(*group).orderBy(*order))).where(F.col("_k") <= most).withColumn("_ok", usable)
    found = F.min(F.when(F.col("_ok"), F.struct("_k", key)))
    out = ranked.groupBy(*group).agg(found.alias("_f"), F.count("*").alias("_tried"))
    return out.select(*group, F.col(f"_f.{key}").alias(key), F.coalesce(F.col("_f._k").cast("bigint"), F.col("_tried")).alias("attempts"))


def fair_quota(df: DataFrame, usable: Column, target: int, cap: int, signer: str, order: tuple[str, ...], *group: str) -> DataFrame:
    """Groups take turns by attempts over target until each has `target` distinct usable signers or the cap of attempts is used up.

    A group's own stop is where its running count of new usable signers reaches the target; a global turn number, the
    rank of (attempt, group) among the attempts needed, gives the cap. Adds attempt, turn and accepted. Only attempts
    within cap of their group are looked at, and the first cap of them all are numbered.
    """
    w = Window.partitionBy(*group).orderBy(*order)
    tried = df.withColumn("attempt", F.row_number().over(w)).where(F.col("attempt") <= cap).withColumn("_ok", F.coalesce(usable, F.lit(False)))
    new = F.row_number().over(Window.partitionBy(*group, signer, "_ok").orderBy(*order)) == 1
    marked = tried.withColumn("accepted", F.col("_ok") & new)
    before = F.coalesce(F.sum(F.col("accepted").cast("int")).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    needed = marked.withColumn("_before", before).where(F.col("_before") < target)
    first = needed.orderBy("attempt", *group).limit(cap)  # each task keeps its first rows, and only cap rows are numbered
    return first.withColumn("turn", F.row_number().over(Window.orderBy("attempt", *group))).drop("_ok", "_before")


def transition_pairs(df: DataFrame, signer: str, label: str, key: str, most: int) -> DataFrame:
    """(signer, first, other) for the first `most` signers with two labels or more: the first row and the first later one of another label."""
    w = Window.partitionBy(signer).orderBy(key)
    marked = df.withColumn("_first", F.first(key).over(w)).withColumn("_label", F.first(label).over(w))
    pairs = marked.where(F.col(label) != F.col("_label")).groupBy(signer).agg(F.first("_first").alias("first"), F.min(key).alias("other"))
    return pairs.orderBy(signer).limit(most)
