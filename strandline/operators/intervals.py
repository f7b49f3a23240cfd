"""Points and intervals of one entity brought together by sweeps: one union and one sort, open intervals as running counts, no range join.

Bounds and points are of one orderable type. Rows with a null entity, bound or place, and intervals that end before they start, meet nothing.
Interval columns must be orderable, as the two ends of an interval find each other by its values; repeated intervals count again.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _swept(points: DataFrame, intervals: DataFrame, at: str, start: str, end: str, by: tuple[str, ...], closed: tuple[bool, bool]) -> tuple[DataFrame, Window]:
    """Points (_p) and both ends of intervals (_v, _opens) in one table with their place `_x`, and the window that walks them in order.

    At one place, a closed start comes before the points and an open one behind them, and ends the other way round.
    """
    known = [F.col(c).isNotNull() for c in by]
    p = points.select(*by, F.struct("*").alias("_p"), F.col(at).alias("_x"), F.lit(1).alias("_o")).where("_x IS NOT NULL")
    whole = F.col(start) <= F.col(end) if all(closed) else F.col(start) < F.col(end)
    v = intervals.where(whole).select(*by, F.struct("*").alias("_v"), F.col(start).alias("_s"), F.col(end).alias("_e"))
    ends = F.explode(F.array(F.struct(F.col("_s").alias("x"), F.lit(0 if closed[0] else 2).alias("o"), F.lit(True).alias("opens")), F.struct(F.col("_e").alias("x"), F.lit(2 if closed[1] else 0).alias("o"), F.lit(False).alias("opens"))))
    marks = v.select(*by, "_v", ends.alias("_m")).select(*by, "_v", F.col("_m.x").alias("_x"), F.col("_m.o").alias("_o"), F.col("_m.opens").alias("_opens"))
    for k in known:
        marks = marks.where(k)
    return p.unionByName(marks, allowMissingColumns=True), Window.partitionBy(*by).orderBy("_x", "_o")


def _so_far(w: Window) -> Window:
    return w.rowsBetween(Window.unboundedPreceding, Window.currentRow)


def with_interval_counts(points: DataFrame, intervals: DataFrame, at: str, start: str, end: str, by: tuple[str, ...] = ("rec",)) -> DataFrame:
    """Adds to each point n_open, how many closed intervals hold it, and n_crossed, how many meet the stretch from the point before to it, both ends included.

    The stretch of an entity's first point is the point itself. Of points at one place each other is the point before.
    """
    rows, w = _swept(points, intervals, at, start, end, by, (True, True))
    count = lambda c: F.sum(F.coalesce(c, F.lit(False)).cast("bigint")).over(_so_far(w))
    is_point = F.col("_p").isNotNull()
    counted = rows.withColumn("_opened", count(F.col("_opens"))).withColumn("_closed", count(~F.col("_opens")))
    before = F.last(F.when(is_point, F.col("_closed")), ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1))
    found = counted.withColumn("_before", F.coalesce(before, F.col("_closed"))).where(is_point)
    return found.select("_p.*", (F.col("_opened") - F.col("_closed")).alias("n_open"), (F.col("_opened") - F.col("_before")).alias("n_crossed"))


def with_point_counts(intervals: DataFrame, points: DataFrame, at: str, start: str, end: str, by: tuple[str, ...] = ("rec",), name: str = "n_points") -> DataFrame:
    """Adds to each interval how many points it holds, both ends included: what has passed at its end but not before its start. Empty intervals hold none."""
    rows, w = _swept(points.select(*by, at), intervals, at, start, end, by, (True, True))
    passed = rows.withColumn("_n", F.count("_p").over(_so_far(w))).where("_v IS NOT NULL")
    both = passed.groupBy(*by, "_v").agg(F.max("_n").alias("_max"), F.min("_n").alias("_min"), F.count_if("_opens").alias("_copies"))
    held = both.select("_v", (F.col("_max") - F.col("_min")).alias(name), F.explode(F.sequence(F.lit(1), "_copies")).alias("_copy")).select("_v.*", name)
    lost = F.coalesce(F.col(start) > F.col(end), F.lit(True))
    for c in by:
        lost = lost | F.col(c).isNull()
    return held.unionByName(intervals.where(lost).withColumn(name, F.lit(0).cast("bigint")))


def stab(points: DataFrame, intervals: DataFrame, at: str, start: str, end: str, by: tuple[str, ...] = ("rec",), closed: tuple[bool, bool] = (True, True)) -> DataFrame:
    """Each point with each interval of its entity that holds it: `by`, `_p` (the point's columns) and `_v` (the interval's). closed: whether start and end belong to it.

    Points between two marks are one group; an interval is known by its first and last group. Both meet by (entity, group), so
    a long sequence is dealt to many tasks, and as each group has a point, no more rows are made than there are results.
    """
    rows, w = _swept(points, intervals, at, start, end, by, closed)
    is_point = F.col("_p").isNotNull()
    opens = is_point & ~F.coalesce(F.lag(is_point).over(w), F.lit(False))
    open_now = F.sum(F.when(F.col("_opens"), 1).when(~F.col("_opens"), -1).otherwise(0)).over(_so_far(w))
    grouped = rows.withColumn("_first", opens).withColumn("_g", F.sum(F.col("_first").cast("bigint")).over(_so_far(w))).withColumn("_now", open_now)
    inside = grouped.where(is_point & (F.col("_now") > 0)).select(*by, "_g", "_p")
    ends = grouped.where("_v IS NOT NULL").groupBy(*by, "_v").agg(F.min(F.when(F.col("_opens"), F.col("_g") + 1)).alias("_from"), F.max(F.when(~F.col("_opens"), F.col("_g"))).alias("_to"), F.count_if("_opens").alias("_copies"))
    groups = ends.where("_to >= _from").select(*by, "_v", "_copies", F.explode(F.sequence("_from", "_to")).alias("_g"))
    met = inside.join(groups, [*by, "_g"])
    return met.select(*by, "_p", "_v", F.explode(F.sequence(F.lit(1), "_copies")).alias("_copy")).drop("_copy")


def struct_fields(struct: str, columns: list[str], but: tuple[str, ...] = ()) -> list[Column]:
    return [F.col(struct)[c].alias(c) for c in columns if c not in but]
