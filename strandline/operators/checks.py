"""Contract checks: each gives all violations as rows (rule_id, keys), and failing is the caller's choice."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def violations(df: DataFrame, rules: dict[str, Column], *keys: str) -> DataFrame:
    """One row per broken rule and row, in one pass. A rule that is NULL is not broken."""
    broken = F.array_compact(F.array(*(F.when(~rule, F.lit(name)) for name, rule in rules.items())))
    return df.select(F.explode(broken).alias("rule_id"), *keys)


def bad_ids(df: DataFrame, column: str, pattern: str, *keys: str) -> DataFrame:
    """Rows whose id is NULL or doesn't match the whole pattern."""
    return df.where(F.col(column).isNull() | ~F.col(column).cast("string").rlike(f"^(?:{pattern})$")).select(*keys, column)


def fk_violations(child: DataFrame, parent: DataFrame, child_key: str, parent_key: str, *keys: str) -> DataFrame:
    """Child rows whose key has no parent; a NULL key counts as missing."""
    p = parent.select(F.col(parent_key).alias("_p"))
    return child.join(p, F.col(child_key) == F.col("_p"), "left_anti").select(*keys)


def used_parents(parent: DataFrame, child: DataFrame, parent_key: str, child_key: str) -> DataFrame:
    """Parents that own a child."""
    c = child.select(F.col(child_key).alias("_c"))
    return parent.join(c, F.col(parent_key) == F.col("_c"), "left_semi")


def group_violations(child: DataFrame, parent: DataFrame, child_key: str, parent_key: str, pairs: dict[str, str], *keys: str) -> DataFrame:
    """(rule_id, keys): copied columns (child: parent) that differ from the parent's; NULL equals NULL."""
    p = parent.select(F.col(parent_key).alias("_key"), *(F.col(b).alias(f"_{b}") for b in pairs.values()))
    joined = child.join(p, F.col(child_key) == F.col("_key"))
    return violations(joined, {f"{a}_differs": F.col(a).eqNullSafe(F.col(f"_{b}")) for a, b in pairs.items()}, *keys)


def containment_violations(child: DataFrame, parent: DataFrame, child_key: str, parent_key: str, child_at: tuple[str, str], parent_at: tuple[str, str], *keys: str) -> DataFrame:
    """(rule_id, keys): children that start before their parent or end after it; an open (NULL) bound holds nothing."""
    p = parent.select(F.col(parent_key).alias("_key"), F.col(parent_at[0]).alias("_start"), F.col(parent_at[1]).alias("_end"))
    joined = child.join(p, F.col(child_key) == F.col("_key"))
    return violations(joined, {"starts_early": F.col(child_at[0]) >= F.col("_start"), "ends_late": F.col(child_at[1]) <= F.col("_end")}, *keys)


def identity_collisions(*tables: tuple[str, DataFrame, str, Column]) -> DataFrame:
    """(identity, kinds, rows, contents) of ids that occur more than once within or across tables (kind, rows, id column, content)."""
    parts = [df.select(F.lit(kind).alias("kind"), F.col(key).cast("string").alias("identity"), content.cast("string").alias("content")) for kind, df, key, content in tables]
    every = reduce(DataFrame.unionByName, parts)
    found = every.groupBy("identity").agg(F.count("*").alias("rows"), F.array_join(F.array_sort(F.collect_set("kind")), ",").alias("kinds"), F.count_distinct("content").alias("contents"))
    return found.where("rows > 1").select("identity", "kinds", "rows", "contents")


def path_collisions(df: DataFrame, path: str, content: str) -> DataFrame:
    """(path, rows, contents) of paths that, letter case aside, hold different contents; NULL paths are left out, a NULL content is one of its own."""
    each = df.where(F.col(path).isNotNull()).groupBy(F.lower(path).alias("path")).agg(F.count("*").alias("rows"), F.count_distinct(F.struct(content)).alias("contents"))
    return each.where("contents > 1")


def inventory_diff(declared: DataFrame, found: DataFrame, key: str, content: str) -> DataFrame:
    """(key, status): missing, extra, changed or unchanged objects."""
    a = declared.select(F.col(key).alias("_a"), F.col(content).alias("_ca"))
    b = found.select(F.col(key).alias("_b"), F.col(content).alias("_cb"))
    status = F.when(F.col("_b").isNull(), "missing").when(F.col("_a").isNull(), "extra").when(F.col("_ca").eqNullSafe(F.col("_cb")), "unchanged").otherwise("changed")
    return a.join(b, F.col("_a") == F.col("_b"), "full").select(F.coalesce("_a", "_b").alias(key), status.alias("status"))


def contiguity_violations(df: DataFrame, ordinal: str, first: int, *by: str) -> DataFrame:
    """Groups whose ordinals aren't first, first + 1, … without gap or repeat."""
    found = df.groupBy(*by).agg(F.min(ordinal).alias("least"), F.max(ordinal).alias("most"), F.count("*").alias("rows"), F.count_distinct(ordinal).alias("kinds"))
    return found.where((F.col("least") != first) | (F.col("most") - first + 1 != F.col("rows")) | (F.col("kinds") != F.col("rows")))


def overlap_violations(df: DataFrame, start: str, end: str, key: str, *by: str) -> DataFrame:
    """Half-open intervals that begin before an earlier one of their group has ended."""
    w = Window.partitionBy(*by).orderBy(start, end, key).rowsBetween(Window.unboundedPreceding, -1)
    return df.withColumn("_reach", F.max(end).over(w)).where(F.col(start) < F.col("_reach")).select(*by, key)


def chain_violations(steps: DataFrame, takes: str, gives: str, order: str, *by: str) -> DataFrame:
    """Steps that don't take what the one before gives."""
    w = Window.partitionBy(*by).orderBy(order)
    before = F.lag(gives).over(w)
    return steps.withColumn("_before", before).withColumn("_k", F.row_number().over(w)).where((F.col("_k") > 1) & ~F.col(takes).eqNullSafe(F.col("_before"))).select(*by, order)


def attempt_chain_violations(attempts: DataFrame, order: str, outcome: str, *by: str, retry: str = "retry", accepted: str = "accepted") -> DataFrame:
    """(rule_id, group, order): attempts after one that wasn't to be retried, and acceptances beyond the first."""
    w = Window.partitionBy(*by).orderBy(order)
    marked = attempts.withColumn("_last", F.lag(outcome).over(w)).withColumn("_won", F.sum((F.col(outcome) == accepted).cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return violations(marked, {"follows_no_retry": F.col("_last").isNull() | (F.col("_last") == retry), "accepted_again": (F.col(outcome) != accepted) | (F.col("_won") == 1)}, *by, order)


def set_difference(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """(key, side) of ids in one set only, by one full join of the distinct ids."""
    x, y = a.select(F.col(key).alias("_a")).distinct(), b.select(F.col(key).alias("_b")).distinct()
    joined = x.join(y, F.col("_a") == F.col("_b"), "full").where("_a IS NULL OR _b IS NULL")
    return joined.select(F.coalesce("_a", "_b").alias(key), F.when(F.col("_b").isNull(), "first_only").otherwise("second_only").alias("side"))


def not_subset(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """Distinct ids of a that b lacks."""
    return a.select(key).distinct().join(b.select(F.col(key).alias("_b")), F.col(key) == F.col("_b"), "left_anti")


def leakage(assignments: DataFrame, partition: str, *ids: str) -> DataFrame:
    """(id_kind, identity, partitions) of ids that occur in two partitions or more, for all kinds of ids in one pass."""
    items = F.array(*(F.struct(F.lit(c).alias("id_kind"), F.col(c).cast("string").alias("identity")) for c in ids))
    long = assignments.select(partition, F.explode(items).alias("x")).select(partition, "x.*").where("identity IS NOT NULL")
    found = long.groupBy("id_kind", "identity").agg(F.array_join(F.array_sort(F.collect_set(partition)), ",").alias("partitions"), F.count_distinct(partition).alias("n"))
    return found.where("n > 1").drop("n")


def repeated_in_group(assignments: DataFrame, identity: str, *group: str) -> DataFrame:
    """Ids that occur more than once in a group."""
    return assignments.groupBy(*group, identity).agg(F.count("*").alias("rows")).where("rows > 1")
