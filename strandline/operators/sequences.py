"""Operators on ordered sequences: every one is a set of windows over (entity, order), so one shuffle by entity serves them all.

A sequence's rows must fit one task (some 10^7 frames); entities are unlimited. Orders must be total within an entity.
"""

from __future__ import annotations

from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import lerp
from .intervals import stab, with_interval_counts, with_point_counts


@dataclass(frozen=True)
class Sequence:
    """The columns that identify a sequence, order it and give its time in microseconds."""

    entity: str = "rec"
    order: str = "i"
    t: str = "t"

    def window(self, *more: str) -> Window:
        return Window.partitionBy(self.entity, *more).orderBy(self.order)


@dataclass(frozen=True)
class GapPolicy:
    """Limits of what may be interpolated, and of a plausible time step."""

    most_frames: int = 2
    most_bridge_us: int = 100_000
    most_step_us: int = 100_000
    step_multiple: int = 3
    least_confidence_ppm: int = 500_000
    swap_margin: float = 0.01


@dataclass(frozen=True, eq=False)
class Hand:
    """Columns of a hand slot: presence, handedness and its confidence in millionths, and wrist and palm as coordinates."""

    present: Column
    label: Column
    confidence: Column
    wrist: tuple[Column, ...]
    palm: tuple[Column, ...]

    def sure(self, policy: GapPolicy) -> Column:
        return F.coalesce(self.present & self.label.isNotNull() & (self.confidence >= policy.least_confidence_ppm), F.lit(False))


def time_steps(frames: DataFrame, seq: Sequence = Sequence()) -> DataFrame:
    """Adds step: the time since the previous row, NULL on the first."""
    return frames.withColumn("step", F.col(seq.t) - F.lag(seq.t).over(seq.window()))


def median_steps(frames: DataFrame, seq: Sequence = Sequence()) -> DataFrame:
    """(entity, median_step): the exact median of steps, halves up; entities of one row have none."""
    steps = time_steps(frames, seq).where("step IS NOT NULL")
    return steps.groupBy(seq.entity).agg(F.floor(F.percentile("step", 0.5) + 0.5).cast("bigint").alias("median_step"))


def with_jumps(frames: DataFrame, policy: GapPolicy, seq: Sequence = Sequence()) -> DataFrame:
    """Adds step, median_step and jump: whether the step isn't positive, or beyond both the absolute limit and the multiple of the median."""
    median = F.floor(F.percentile("step", 0.5).over(Window.partitionBy(seq.entity)) + 0.5).cast("bigint")
    found = time_steps(frames, seq).withColumn("median_step", median)
    far = (F.col("step") > policy.most_step_us) & (F.col("step") > F.col("median_step") * policy.step_multiple)
    return found.withColumn("jump", F.coalesce((F.col("step") <= 0) | far, F.lit(False)))


def timestamp_discontinuities(frames: DataFrame, policy: GapPolicy, seq: Sequence = Sequence()) -> DataFrame:
    """The rows of with_jumps that are jumps."""
    return with_jumps(frames, policy, seq).where("jump").drop("jump")


def with_speed(frames: DataFrame, slots: dict[str, tuple[Column, tuple[Column, ...]]], seq: Sequence = Sequence()) -> DataFrame:
    """Adds step and speed in units a second, that of the fastest slot present in both neighbours; NULL where there is none or the step isn't positive.

    slots: presence and coordinates of each slot.
    """
    w = seq.window()
    speeds = []
    for present, points in slots.values():
        both = present & F.lag(present).over(w)
        square = sum((F.pow(p - F.lag(p).over(w), 2) for p in points), F.lit(0.0))
        speeds.append(F.when(both & (F.col("step") > 0), F.sqrt(square) / (F.col("step") / 1e6)))
    return time_steps(frames, seq).withColumn("speed", F.greatest(*speeds) if len(speeds) > 1 else speeds[0])


def motion_discontinuities(frames: DataFrame, slots: dict[str, tuple[Column, tuple[Column, ...]]], limit: float, seq: Sequence = Sequence()) -> DataFrame:
    """(entity, order, speed): rows whose speed, as with_speed gives it, is beyond limit."""
    return with_speed(frames, slots, seq).where(F.col("speed") > limit).select(seq.entity, seq.order, "speed")


def missing_intervals(frames: DataFrame, signals: dict[str, Column], invalid: Column | None = None, seq: Sequence = Sequence(), hands: dict[str, Hand] | None = None, policy: GapPolicy = GapPolicy(), jump: Column | None = None) -> DataFrame:
    """Maximal runs of absent rows of each signal, with bounds, neighbours, boundary kind and duration.

    A duration runs between the observed neighbours; where one is missing, from or to the run's own end. With two hands, a run also
    tells for signals that are hands whether it lies in a suspected swap (swapped), whether that or different handedness at two
    confident ends makes its identity ambiguous, and whether an observed end isn't confident (unsure). With jump, it tells whether one of its rows
    or its right neighbour is a jump (jumped). Swaps that frames already tell (in_swap) aren't looked for again.
    """
    frames = frames.withColumn("_invalid", F.coalesce(invalid, F.lit(False)) if invalid is not None else F.lit(False)).withColumn("_jump", jump if jump is not None else F.lit(False))
    if hands and "in_swap" not in frames.columns:
        frames = with_swaps(frames, tuple(hands.values()), policy, seq)
    none = F.struct(F.lit(None).cast("string").alias("label"), F.lit(True).alias("sure"), F.lit(False).alias("swapped"))

    def item(name: str, present: Column) -> Column:
        end = F.struct(hands[name].label.cast("string").alias("label"), hands[name].sure(policy).alias("sure"), F.coalesce("in_swap", F.lit(False)).alias("swapped")) if hands and name in hands else none
        return F.struct(F.lit(name).alias("signal"), present.alias("present"), end.alias("end"))

    long = frames.select(seq.entity, seq.order, seq.t, "_invalid", "_jump", F.explode(F.array(*(item(k, v) for k, v in signals.items()))).alias("s")).select(seq.entity, seq.order, seq.t, "_invalid", "_jump", "s.*")
    w = seq.window("signal")
    long = long.withColumn("_before", F.lag(seq.t).over(w)).withColumn("_after", F.lead(seq.t).over(w)).withColumn("_k", F.row_number().over(w))
    long = long.withColumn("_left", F.lag("end").over(w)).withColumn("_right", F.lead("end").over(w)).withColumn("_jump", F.col("_jump") | F.coalesce(F.lead("_jump").over(w), F.lit(False)))
    absent = long.where(~F.col("present")).withColumn("_island", F.col("_k") - F.row_number().over(w))
    ends = [F.min_by("_left", "_k").alias("_left"), F.max_by("_right", "_k").alias("_right"), F.bool_or("end.swapped").alias("swapped")] if hands else []
    if jump is not None:
        ends = [*ends, F.bool_or("_jump").alias("jumped")]
    runs = absent.groupBy(seq.entity, "signal", "_island").agg(
        F.min(seq.order).alias("first_index"), F.max(seq.order).alias("last_index"), F.min(seq.t).alias("first_t"), F.max(seq.t).alias("last_t"),
        F.count("*").alias("missing"), F.min_by("_before", "_k").alias("left_t"), F.max_by("_after", "_k").alias("right_t"), F.bool_or("_invalid").alias("has_invalid"), *ends,
    )
    no_left, no_right = F.col("left_t").isNull(), F.col("right_t").isNull()
    boundary = F.when(no_left & no_right, "entire_sequence").when(no_left, "leading").when(no_right, "trailing").otherwise("internal")
    duration = F.coalesce("right_t", "last_t") - F.coalesce("left_t", "first_t")
    runs = runs.drop("_island").withColumn("boundary", boundary).withColumn("duration", duration)
    if not hands:
        return runs
    differ = F.coalesce(F.col("_left.sure") & F.col("_right.sure") & (F.col("_left.label") != F.col("_right.label")), F.lit(False))
    return runs.withColumn("ambiguous", F.col("swapped") | differ).withColumn("unsure", ~F.coalesce("_left.sure", F.lit(True)) | ~F.coalesce("_right.sure", F.lit(True))).drop("_left", "_right")


def gap_barriers(gaps: DataFrame, points: DataFrame, name: str, seq: Sequence = Sequence()) -> DataFrame:
    """Adds name: whether an event row of the entity lies in the gap's transition, from the first missing row (or the one after, at the start) to the right neighbour."""
    start = F.when(F.col("left_t").isNull(), F.col("first_index") + 1).otherwise(F.col("first_index"))
    end = F.when(F.col("right_t").isNull(), F.col("last_index")).otherwise(F.col("last_index") + 1)
    spans = gaps.withColumn("_from", start).withColumn("_until", end)
    counted = with_point_counts(spans, points.select(seq.entity, F.col(seq.order).alias("_at")), "_at", "_from", "_until", (seq.entity,), "_n")
    return counted.withColumn(name, F.col("_n") > 0).drop("_from", "_until", "_n")


def decide_gaps(gaps: DataFrame, policy: GapPolicy, barriers: dict[str, str] | None = None) -> DataFrame:
    """Adds decision and its sorted reasons. barriers: boolean columns of gaps and the reason each gives."""
    reason = lambda when, name: F.when(when, F.lit(name))
    found = [
        reason(F.col("boundary") == "leading", "leading_gap"), reason(F.col("boundary") == "trailing", "trailing_gap"), reason(F.col("boundary") == "entire_sequence", "entire_sequence_missing"),
        reason(F.col("missing") > policy.most_frames, "too_many_missing_frames"), reason(F.col("duration") > policy.most_bridge_us, "bridge_too_long"), reason(F.col("has_invalid"), "invalid_frame"),
        *(reason(F.col(c), r) for c, r in (barriers or {}).items()),
    ]
    reasons = F.array_sort(F.array_compact(F.array(*found)))
    decided = gaps.withColumn("_reasons", reasons).withColumn("decision", F.when(F.size("_reasons") == 0, "interpolate_linear").otherwise("preserve_missing"))
    return decided.withColumn("reasons", F.when(F.size("_reasons") == 0, F.array(F.lit("eligible_short_internal_gap"))).otherwise(F.col("_reasons"))).drop("_reasons")


def decided_gaps(frames: DataFrame, signals: dict[str, Column], policy: GapPolicy, invalid: Column | None = None, hands: dict[str, Hand] | None = None, seq: Sequence = Sequence()) -> DataFrame:
    """The missing intervals of all signals with their barriers (time jumps; with hands also identity and confidence) and decisions.

    One shuffle by entity serves jumps, swaps, runs and barriers. Frames that already have jump and in_swap (with_jumps, with_swaps) keep them.
    """
    marked = frames if "jump" in frames.columns else with_jumps(frames, policy, seq)
    gaps = missing_intervals(marked, signals, invalid, seq, hands, policy, F.col("jump"))
    more = {"ambiguous": "identity_ambiguity", "unsure": "low_confidence"} if hands else {}
    return decide_gaps(gaps, policy, {"jumped": "timestamp_discontinuity"} | more)


def bridged_presence(frames: DataFrame, present: Column, policy: GapPolicy, seq: Sequence = Sequence()) -> DataFrame:
    """Adds bridged: present, or inside a short absence between two present rows."""
    w = seq.window()
    after = w.rowsBetween(0, Window.unboundedFollowing)
    before = w.rowsBetween(Window.unboundedPreceding, 0)
    marked = frames.withColumn("_p", F.coalesce(present, F.lit(False))).withColumn("_k", F.row_number().over(w))
    seen_t, seen_k = F.when(F.col("_p"), F.col(seq.t)), F.when(F.col("_p"), F.col("_k"))
    marked = marked.withColumn("_lt", F.last(seen_t, ignorenulls=True).over(before)).withColumn("_lk", F.last(seen_k, ignorenulls=True).over(before))
    marked = marked.withColumn("_rt", F.first(seen_t, ignorenulls=True).over(after)).withColumn("_rk", F.first(seen_k, ignorenulls=True).over(after))
    short = (F.col("_rk") - F.col("_lk") - 1 <= policy.most_frames) & (F.col("_rt") - F.col("_lt") <= policy.most_bridge_us)
    return marked.withColumn("bridged", F.col("_p") | F.coalesce(short, F.lit(False))).drop("_k", "_lt", "_lk", "_rt", "_rk")


def episodes(frames: DataFrame, present: Column, policy: GapPolicy, motion: str | None = None, seq: Sequence = Sequence()) -> DataFrame:
    """Runs of bridged presence: first and last order and time, observed rows, and the summed motion column."""
    w = seq.window()
    marked = bridged_presence(frames, present, policy, seq)
    starts = F.col("bridged") & ~F.coalesce(F.lag("bridged").over(w), F.lit(False))
    numbered = marked.withColumn("episode", F.sum(starts.cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    observed = F.col("_p")
    return numbered.where("bridged").groupBy(seq.entity, "episode").agg(
        F.min(seq.order).alias("first_index"), F.max(seq.order).alias("last_index"), F.min(seq.t).alias("first_t"), F.max(seq.t).alias("last_t"),
        F.count_if(observed).alias("observed"), F.sum(F.when(observed, F.col(motion)) if motion else F.lit(0)).alias("motion"),
    )


def best_episode(entities: DataFrame, found: DataFrame, least_observed: int = 3, seq: Sequence = Sequence()) -> DataFrame:
    """Per entity its best episode: most observed rows, then motion, then span, then the earliest; status tells why there is none."""
    rank = F.struct("observed", "motion", F.col("last_t") - F.col("first_t"), -F.col("first_index"))
    best = found.groupBy(seq.entity).agg(F.max_by(F.struct("first_index", "last_index", "first_t", "last_t", "observed", "motion"), rank).alias("b"))
    joined = entities.select(seq.entity).distinct().join(best, seq.entity, "left")
    status = F.when(F.col("b").isNull(), "no_episode").when(F.col("b.observed") < least_observed, "too_few_observed").otherwise("selected")
    return joined.select(seq.entity, status.alias("status"), "b.*")


def slice_and_rebase(frames: DataFrame, windows: DataFrame, seq: Sequence = Sequence()) -> DataFrame:
    """Rows of each entity's window (first_index to last_index), order and time restarting at 0."""
    bounds = windows.select(seq.entity, "first_index", "last_index", "first_t")
    inside = stab(frames, bounds, seq.order, "first_index", "last_index", (seq.entity,))
    moved = {seq.t: F.col("_p")[seq.t] - F.col("_v.first_t"), seq.order: F.col("_p")[seq.order] - F.col("_v.first_index")}
    return inside.select(*(moved.get(c, F.col("_p")[c]).alias(c) for c in frames.columns))


def monotone_ms(frames: DataFrame, seq: Sequence = Sequence()) -> DataFrame:
    """Adds task_ms, m(i) = max(floor(t/1000), m(i-1) + 1), by its closed form: position plus a running maximum."""
    w = seq.window()
    k = F.row_number().over(w)
    shifted = F.floor(F.col(seq.t) / 1000).cast("bigint") - F.col("_k")
    run = F.max(shifted).over(w.rowsBetween(Window.unboundedPreceding, 0))
    return frames.withColumn("_k", k).withColumn("task_ms", (F.col("_k") + run).cast("bigint")).drop("_k")


def smooth(frames: DataFrame, value: str, usable: Column, alpha_ppm: int = 500_000, seq: Sequence = Sequence()) -> DataFrame:
    """(entity, order, smoothed): integer exponential smoothing over usable rows; a sequence's first usable value starts it.

    The recurrence rounds at each step, so no window expresses it: one loop runs over a sequence's sorted values.
    """
    rows = frames.where(usable).select(seq.entity, F.col(seq.order).cast("bigint").alias(seq.order), F.col(value).cast("bigint").alias("smoothed"))

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by(seq.order)
        out, last = [], None
        for v in table.column("smoothed").to_pylist():
            last = v if last is None else (alpha_ppm * v + (1_000_000 - alpha_ppm) * last + 500_000) // 1_000_000
            out.append(last)
        return table.set_column(table.schema.get_field_index("smoothed"), "smoothed", pa.array(out, pa.int64()))

    kind = rows.schema[seq.entity].dataType.simpleString()
    return rows.groupBy(seq.entity).applyInArrow(run, f"`{seq.entity}` {kind}, `{seq.order}` bigint, smoothed bigint")


def bracket_join(grid: DataFrame, samples: DataFrame, value: str, by: tuple[str, ...] = ("rec",), t: str = "t") -> DataFrame:
    """Each grid time with the last sample at or before it and the first at or after it: left_t, left_v, right_t, right_v.

    As-of joins in both directions by one union and one sort within `by`.
    """
    kind = samples.schema[value].dataType.simpleString()
    both = grid.select(*by, t, F.lit(1).alias("_g"), F.lit(None).cast(kind).alias("_v")).unionByName(samples.select(*by, t, F.lit(0).alias("_g"), F.col(value).alias("_v")))
    sample = F.when(F.col("_g") == 0, F.struct(F.col(t).alias("t"), F.col("_v").alias("v")))
    back = Window.partitionBy(*by).orderBy(t, "_g").rowsBetween(Window.unboundedPreceding, 0)
    ahead = Window.partitionBy(*by).orderBy(F.desc(t), "_g").rowsBetween(Window.unboundedPreceding, 0)
    found = both.withColumn("_l", F.last(sample, ignorenulls=True).over(back)).withColumn("_r", F.last(sample, ignorenulls=True).over(ahead))
    return found.where("_g = 1").select(*by, t, F.col("_l.t").alias("left_t"), F.col("_l.v").alias("left_v"), F.col("_r.t").alias("right_t"), F.col("_r.v").alias("right_v"))


def gap_at(grid: DataFrame, gaps: DataFrame, by: tuple[str, ...] = ("rec",), t: str = "t") -> DataFrame:
    """Each grid time with the first approved gap (left_t to right_t) that holds it, or NULLs."""
    spans = gaps.select(*by, F.col("left_t").alias("gap_left"), F.col("right_t").alias("gap_right"))
    hit = stab(grid.select(*by, t), spans, t, "gap_left", "gap_right", by, closed=(False, False)).groupBy(*by, F.col("_p")[t].alias(t)).agg(F.min(F.struct("_v.gap_left", "_v.gap_right")).alias("g"))
    return grid.join(hit, [*by, t], "left").select(*by, t, F.col("g.gap_left").alias("gap_left"), F.col("g.gap_right").alias("gap_right"))


def interpolate(bracketed: DataFrame) -> DataFrame:
    """Adds value by linear interpolation between the bracket's ends."""
    return bracketed.withColumn("value", lerp("left_v", "right_v", "left_t", "right_t", "t"))


def with_barrier(frames: DataFrame, gaps: DataFrame, name: str = "barrier", by: tuple[str, ...] = ("rec",), t: str = "t") -> DataFrame:
    """Adds name: whether a preserved gap (first_t to last_t of its missing rows) meets the stretch from the row before to this one. A sequence's first row has no stretch."""
    kept = gaps.where("decision = 'preserve_missing'").select(*by, "first_t", "last_t")
    counted = with_interval_counts(frames, kept, t, "first_t", "last_t", by)
    first = F.lag(t).over(Window.partitionBy(*by).orderBy(t)).isNull()
    return counted.withColumn(name, (F.col("n_crossed") > 0) & ~first).drop("n_open", "n_crossed")


def differences(frames: DataFrame, value: str, barrier: Column | None = None, out: str = "velocity", seq: Sequence = Sequence()) -> DataFrame:
    """Adds the backward difference per second; NULL where either value is, or where barrier (a gap that was kept lies between; see with_barrier) holds."""
    w = seq.window()
    seconds = (F.col(seq.t) - F.lag(seq.t).over(w)) / 1e6
    ok = (seconds > 0) & ~F.coalesce(barrier if barrier is not None else F.lit(False), F.lit(False))
    return frames.withColumn(out, F.when(ok, (F.col(value) - F.lag(value).over(w)) / seconds))


def with_swaps(frames: DataFrame, hands: tuple[Hand, Hand], policy: GapPolicy, seq: Sequence = Sequence()) -> DataFrame:
    """Adds swap_from and in_swap. swap_from: on a row with both hands, the order of the last such row before if the hands seem to have swapped since.

    They have if all four hands are confident, their labels cross, and the crossed cost plus the margin is below the straight one; a cost is the
    squared distance of wrists plus that of palms. in_swap: the next row with both hands (or the row itself) is the end of such a span.
    """
    w = seq.window()
    a, b = hands
    slot = lambda h: F.struct(h.label.alias("label"), F.array(*h.wrist, *h.palm).alias("at"))
    both = F.coalesce(a.present & b.present, F.lit(False))
    found = frames.withColumn("_now", F.when(both, F.struct(F.col(seq.order).alias("order"), (a.sure(policy) & b.sure(policy)).alias("sure"), slot(a).alias("s0"), slot(b).alias("s1"))))
    found = found.withColumn("_old", F.last("_now", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1)))

    def cost(old: int, new: int) -> Column:
        steps = [F.get(f"_old.s{old}.at", F.lit(k)) - F.get(f"_now.s{new}.at", F.lit(k)) for k in range(len(a.wrist) + len(a.palm))]
        return sum((d * d for d in steps), F.lit(0.0))

    label = lambda when, k: F.col(f"{when}.s{k}.label")
    crossed = (label("_old", 0) != label("_old", 1)) & (label("_old", 0) == label("_now", 1)) & (label("_old", 1) == label("_now", 0))
    swapped = F.col("_old.sure") & F.col("_now.sure") & crossed & (cost(0, 1) + cost(1, 0) + policy.swap_margin < cost(0, 0) + cost(1, 1))
    found = found.withColumn("swap_from", F.when(F.coalesce(swapped, F.lit(False)), F.col("_old.order")))
    ahead = F.first(F.when(F.col("_now").isNotNull(), F.col("swap_from").isNotNull()), ignorenulls=True).over(w.rowsBetween(0, Window.unboundedFollowing))
    return found.withColumn("in_swap", F.coalesce(ahead, F.lit(False))).drop("_now", "_old")


def suspected_swaps(frames: DataFrame, hands: tuple[Hand, Hand], policy: GapPolicy, seq: Sequence = Sequence()) -> DataFrame:
    """(entity, from_index, to_index): the spans of with_swaps."""
    return with_swaps(frames, hands, policy, seq).where("swap_from IS NOT NULL").select(seq.entity, F.col("swap_from").alias("from_index"), F.col(seq.order).alias("to_index"))
