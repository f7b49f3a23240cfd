"""Interval matching and event-level scoring."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import iou_ppm
from ..sources.staging import written


def candidate_pairs(truths: DataFrame, decisions: DataFrame, session: str, least_iou_ppm: int, bin_us: int | None = None) -> DataFrame:
    """(session, truth_id, t_start, t_end, decision_id, d_start, d_end, iou): overlapping pairs of a session with that overlap.

    With bin_us both sides are dealt to bins of time, so that a hot session is spread too; a pair is taken in the first bin that
    both reach. Without it the join is by session, with the range as its condition.
    """
    t = truths.select(F.col(session).alias("s"), "truth_id", F.col("start_us").alias("t_start"), F.col("end_us").alias("t_end"))
    d = decisions.select(F.col(session).alias("_s"), "decision_id", F.col("start_us").alias("d_start"), F.col("end_us").alias("d_end"))
    on = (F.col("s") == F.col("_s")) & (F.col("t_start") < F.col("d_end")) & (F.col("d_start") < F.col("t_end"))
    if bin_us:
        bins = lambda lo, hi: F.explode(F.sequence(F.floor(F.col(lo) / bin_us), F.floor(F.col(hi) / bin_us)))
        t, d = t.withColumn("_tb", bins("t_start", "t_end")), d.withColumn("_db", bins("d_start", "d_end"))
        on = on & (F.col("_tb") == F.col("_db")) & (F.col("_tb") == F.floor(F.greatest("t_start", "d_start") / bin_us))
    scored = t.join(d, on).withColumn("iou", iou_ppm("t_start", "t_end", "d_start", "d_end")).where(F.col("iou") >= least_iou_ppm)
    return scored.select(F.col("s").alias(session), "truth_id", "t_start", "t_end", "decision_id", "d_start", "d_end", "iou")


def match_intervals(truths: DataFrame, decisions: DataFrame, session: str = "session", least_iou_ppm: int = 200_000, bin_us: int | None = None, most_edges: int = 20_000, least_calls: int = 64) -> DataFrame:
    """One-to-one (session, truth_id, decision_id, iou): in time order each truth takes the free decision of the largest overlap (ties: earliest, then id).

    Only candidate edges are grouped, in runs of a session: edges whose truths and decisions touch no others in time, so a session of any
    length is cut where nothing overlaps. Runs are dealt to calls of about most_edges edges; one run is a cluster of overlapping intervals.
    """
    edges = candidate_pairs(truths, decisions, session, least_iou_ppm, bin_us)
    spans = edges.withColumn("_lo", F.least("t_start", "d_start")).withColumn("_hi", F.greatest("t_end", "d_end"))
    w = Window.partitionBy(session).orderBy("_lo", "_hi", "truth_id", "decision_id")
    opens = F.col("_lo") >= F.coalesce(F.max("_hi").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.col("_lo"))
    run = F.sum(opens.cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0))
    found = written(spans.withColumn("_run", run).select(session, "truth_id", "decision_id", "iou", "t_start", "d_start", "_run"), "match-edges")
    calls = max(least_calls, -(-found.count() // most_edges))
    marked = found.withColumn("_call", F.pmod(F.xxhash64(session, "_run"), F.lit(calls)))

    def greedy(table: pa.Table) -> pa.Table:
        table = table.sort_by([(session, "ascending"), ("_run", "ascending"), ("t_start", "ascending"), ("truth_id", "ascending"), ("iou", "descending"), ("d_start", "ascending"), ("decision_id", "ascending")])
        taken, done, keep = set(), set(), []
        for k, (s, truth, decision) in enumerate(zip(*(table.column(c).to_pylist() for c in (session, "truth_id", "decision_id")))):
            if (s, truth) not in done and (s, decision) not in taken:
                done.add((s, truth)), taken.add((s, decision)), keep.append(k)
        return table.take(pa.array(keep, pa.int64())).select([session, "truth_id", "decision_id", "iou"])

    schema = ", ".join(f"`{c}` {marked.schema[c].dataType.simpleString()}" for c in (session, "truth_id", "decision_id", "iou"))
    return marked.groupBy("_call").applyInArrow(greedy, schema)


def ordered_match(truths: DataFrame, events: DataFrame, session: str = "session") -> DataFrame:
    """Per session: counts, whether the k-th truth overlaps the k-th event for all k, and mean absolute onset and offset errors."""
    w = Window.partitionBy(session).orderBy("start_us", "end_us")
    t = truths.select(F.col(session).alias("s"), F.row_number().over(w).alias("k"), F.col("start_us").alias("t0"), F.col("end_us").alias("t1"))
    e = events.select(F.col(session).alias("s"), F.row_number().over(w).alias("k"), F.col("start_us").alias("e0"), F.col("end_us").alias("e1"))
    both = t.join(e, ["s", "k"], "full")
    overlap = (F.col("t0") < F.col("e1")) & (F.col("e0") < F.col("t1"))
    out = both.groupBy("s").agg(F.count("t0").alias("truths"), F.count("e0").alias("events"), F.bool_and(F.coalesce(overlap, F.lit(False))).alias("conforms"), F.avg(F.abs(F.col("e0") - F.col("t0"))).alias("onset_error"), F.avg(F.abs(F.col("e1") - F.col("t1"))).alias("offset_error"))
    return out.withColumnRenamed("s", session)


def replay_counts(truths: DataFrame, decisions: DataFrame, matches: DataFrame, session: str = "session") -> DataFrame:
    """Per session: truths, accepted, other, abstained, matches, correct, misses, duplicates (unmatched but overlapping a truth) and false activations.

    decisions have a kind (target, other, abstain) and a label; targets and others count as accepted.
    """
    acc = decisions.where(F.col("kind") != "abstain")
    m = matches.select(F.col(session).alias("ms"), F.col("truth_id").alias("mt"), F.col("decision_id").alias("md"))
    free = acc.join(m, (F.col(session) == F.col("ms")) & (F.col("decision_id") == F.col("md")), "left_anti")
    t = truths.select(F.col(session).alias("ts"), F.col("start_us").alias("t0"), F.col("end_us").alias("t1"))
    overlapping = free.join(t, (F.col(session) == F.col("ts")) & (F.col("start_us") < F.col("t1")) & (F.col("t0") < F.col("end_us")), "left_semi")
    labels = m.join(truths.select(F.col(session).alias("s1"), F.col("truth_id").alias("i1"), F.col("label").alias("tl")), (F.col("ms") == F.col("s1")) & (F.col("mt") == F.col("i1"))).join(decisions.select(F.col(session).alias("s2"), F.col("decision_id").alias("i2"), F.col("label").alias("dl"), F.col("kind").alias("dk")), (F.col("ms") == F.col("s2")) & (F.col("md") == F.col("i2")))
    parts = [
        truths.groupBy(F.col(session).alias("x")).agg(F.count("*").alias("truths")),
        decisions.groupBy(F.col(session).alias("x")).agg(F.count_if(F.col("kind") != "abstain").alias("accepted"), F.count_if(F.col("kind") == "other").alias("other"), F.count_if(F.col("kind") == "abstain").alias("abstained")),
        labels.groupBy(F.col("ms").alias("x")).agg(F.count("*").alias("matches"), F.count_if((F.col("tl") == F.col("dl")) & (F.col("dk") == "target")).alias("correct")),
        overlapping.groupBy(F.col(session).alias("x")).agg(F.count("*").alias("duplicates")),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.join(p, "x", "full")
    names = ("truths", "accepted", "other", "abstained", "matches", "correct", "duplicates")
    filled = out.select(F.col("x").alias(session), *(F.coalesce(c, F.lit(0).cast("bigint")).alias(c) for c in names))
    return filled.withColumn("misses", F.col("truths") - F.col("matches")).withColumn("false_activations", F.col("accepted") - F.col("matches") - F.col("duplicates"))


def replay_metrics(counts: DataFrame, duration_us: int) -> DataFrame:
    """Sums over all sessions with precision, recall, F1 (rounded, NULL for 0/0) and false activations an hour."""
    names = ("truths", "accepted", "matches", "correct", "misses", "duplicates", "false_activations")
    total = counts.agg(*(F.sum(c).alias(c) for c in names))
    ratio = lambda n, d: F.when(d > 0, F.round(n / d, 6))
    return total.withColumn("precision", ratio(F.col("matches"), F.col("accepted"))).withColumn("recall", ratio(F.col("matches"), F.col("truths"))).withColumn("f1", ratio(2 * F.col("matches"), F.col("accepted") + F.col("truths"))).withColumn("false_per_hour", F.round(F.col("false_activations") * 3.6e9 / duration_us, 6))
