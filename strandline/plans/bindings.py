"""Test tables in the roles of the operators' inputs, once for Spark and once as SQL (common table expressions).

frames: events as frame sequences, a user being a recording; points: pseudo landmarks by integer arithmetic on event_id.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.quality import palm_quantized
from ..operators.sequences import GapPolicy, Hand

HOUR = 3_600_000_000
POLICY = GapPolicy(most_frames=2, most_bridge_us=36 * HOUR, most_step_us=48 * HOUR, step_multiple=3, least_confidence_ppm=200_000, swap_margin=0.01)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """rec, i, t (from 0), h0, h1, invalid, q (millionths), event_id, kind, label."""
    e = table(spark, sf_dir, "events").where("user_id IS NOT NULL AND ts IS NOT NULL")
    w = Window.partitionBy("rec").orderBy("us", "event_id")
    e = e.select(F.col("user_id").alias("rec"), F.unix_micros(F.col("ts").cast("timestamp")).alias("us"), "event_id", "event_type", F.floor(F.col("value") * 1_000_000).cast("bigint").alias("q"))
    return e.select(
        "rec", (F.row_number().over(w) - 1).cast("bigint").alias("i"), (F.col("us") - F.first("us").over(w)).alias("t"), ((F.col("event_type") != "error") & (F.col("event_id") % 11 != 0)).alias("h0"),
        F.col("event_type").isin("click", "view", "purchase").alias("h1"), (F.col("event_id") % 29 == 0).alias("invalid"), "q", "event_id", F.col("event_type").alias("kind"), "us",
    )


FRAMES = """frames AS (
  SELECT user_id AS rec, row_number() OVER w - 1 AS i, epoch_us(ts) - first_value(epoch_us(ts)) OVER w AS t,
         event_type <> 'error' AND event_id % 11 <> 0 AS h0, event_type IN ('click', 'view', 'purchase') AS h1, event_id % 29 = 0 AS invalid,
         CAST(floor(value * 1000000) AS BIGINT) AS q, event_id, event_type AS kind, epoch_us(ts) AS us
  FROM events WHERE user_id IS NOT NULL AND ts IS NOT NULL WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))"""

#: Steps, exact medians and implausible steps.
STEPS = f"""{FRAMES},
steps AS (SELECT *, t - lag(t) OVER (PARTITION BY rec ORDER BY i) AS step FROM frames),
medians AS (SELECT rec, CAST(floor(quantile_cont(step, 0.5) + 0.5) AS BIGINT) AS median_step FROM steps WHERE step IS NOT NULL GROUP BY rec),
jumps AS (SELECT s.*, median_step FROM steps s JOIN medians USING (rec) WHERE step <= 0 OR (step > {48 * HOUR} AND step > 3 * median_step))"""

#: Missing runs of both hand signals.
GAPS = f"""{STEPS},
long AS (SELECT rec, i, t, invalid, signal, present FROM (SELECT rec, i, t, invalid, unnest(['hand_0', 'hand_1']) AS signal, unnest([h0, h1]) AS present FROM frames)),
near AS (SELECT *, lag(t) OVER w AS before, lead(t) OVER w AS after FROM long WINDOW w AS (PARTITION BY rec, signal ORDER BY i)),
runs AS (SELECT *, i - row_number() OVER (PARTITION BY rec, signal ORDER BY i) AS island FROM near WHERE NOT present),
gaps AS (SELECT rec, signal, min(i) AS first_index, max(i) AS last_index, min(t) AS first_t, max(t) AS last_t, count(*) AS missing, arg_min(struct_pack(x := before), i).x AS left_t, arg_max(struct_pack(x := after), i).x AS right_t,
  bool_or(invalid) AS has_invalid FROM runs GROUP BY rec, signal, island),
kinds AS (SELECT *, CASE WHEN left_t IS NULL AND right_t IS NULL THEN 'entire_sequence' WHEN left_t IS NULL THEN 'leading' WHEN right_t IS NULL THEN 'trailing' ELSE 'internal' END AS boundary,
  coalesce(right_t, last_t) - coalesce(left_t, first_t) AS duration FROM gaps)"""

def point(event_id: str | None = None, k: int = 0, axis: int = 0):
    """Coordinate of pseudo landmark k in [0, 1): the same integers in both engines."""
    return (F.col("event_id") * (7 + axis) + 13 * k + 5 * axis) % 1000 / 1000.0


def point_sql(k: int = 0, axis: int = 0, event_id: str = "event_id") -> str:
    return f"(({event_id} * {7 + axis} + {13 * k + 5 * axis}) % 1000 / 1000.0)::DOUBLE"


def palm_q(base: int, axis: int = 0):
    """Coordinate of a hand's palm, the mean of its points 0, 5, 9 and 17, in millionths."""
    return palm_quantized([point(k=base + k, axis=axis) for k in (0, 5, 9, 17)])


def palm_q_sql(base: int, axis: int = 0) -> str:
    return f"round_even(({' + '.join(point_sql(base + k, axis) for k in (0, 5, 9, 17))}) * 1000000 / 4, 0)::BIGINT"


def hands() -> dict[str, Hand]:
    """Both hand slots in three dimensions; the parity of event_id says which is the left one."""
    at = lambda k: tuple(point(k=k, axis=x) for x in (0, 1, 2))
    side = [F.when(F.col("event_id") % 2 == k, "left").otherwise("right") for k in (0, 1)]
    return {f"hand_{k}": Hand(F.col(f"h{k}"), side[k], F.col("event_id") * (11 + 2 * k) % 1000 * 1000, at(50 * k), at(50 * k + 9)) for k in (0, 1)}


def _unsure(event_id: str, k: str) -> str:
    return f"({event_id} * (11 + 2 * {k}) % 1000 * 1000 < 200000)"


def _swap_cost(old: int, new: int) -> str:
    steps = [f"({point_sql(50 * old + p, x, 'old')} - {point_sql(50 * new + p, x)})" for p in (0, 9) for x in (0, 1, 2)]
    return "(" + " + ".join(f"{d} * {d}" for d in steps) + ")"


#: Spans between rows with both hands in which the hands seem to swap; needs frames.
SWAPS = f"""two AS (SELECT rec, i, event_id, lag(i) OVER w AS from_index, lag(event_id) OVER w AS old FROM frames WHERE h0 AND h1 WINDOW w AS (PARTITION BY rec ORDER BY i)),
swaps AS (SELECT rec, from_index, i AS to_index FROM two WHERE event_id % 2 <> old % 2 AND NOT ({_unsure('old', '0')} OR {_unsure('old', '1')} OR {_unsure('event_id', '0')} OR {_unsure('event_id', '1')})
  AND {_swap_cost(0, 1)} + {_swap_cost(1, 0)} + 0.01::DOUBLE < {_swap_cost(0, 0)} + {_swap_cost(1, 1)})"""

DECIDED = f"""{GAPS},
{SWAPS},
ends AS (SELECT k.*, l.event_id AS le, r.event_id AS re, CASE signal WHEN 'hand_0' THEN 0 ELSE 1 END AS slot FROM kinds k LEFT JOIN frames l ON l.rec = k.rec AND l.i = k.first_index - 1 LEFT JOIN frames r ON r.rec = k.rec AND r.i = k.last_index + 1),
crossed AS (SELECT k.*, EXISTS (SELECT 1 FROM jumps j WHERE j.rec = k.rec AND j.i BETWEEN CASE WHEN left_t IS NULL THEN first_index + 1 ELSE first_index END
    AND CASE WHEN right_t IS NULL THEN last_index ELSE last_index + 1 END) AS jumped,
  EXISTS (SELECT 1 FROM swaps s WHERE s.rec = k.rec AND s.from_index <= first_index AND last_index < s.to_index) AS swapped,
  coalesce({_unsure('le', 'slot')}, FALSE) OR coalesce({_unsure('re', 'slot')}, FALSE) AS unsure FROM ends k),
named AS (SELECT *, swapped OR coalesce(NOT unsure AND le % 2 <> re % 2, FALSE) AS ambiguous FROM crossed),
reasoned AS (SELECT *, list_sort(list_filter([CASE boundary WHEN 'leading' THEN 'leading_gap' WHEN 'trailing' THEN 'trailing_gap' WHEN 'entire_sequence' THEN 'entire_sequence_missing' END,
    CASE WHEN missing > 2 THEN 'too_many_missing_frames' END, CASE WHEN duration > {36 * HOUR} THEN 'bridge_too_long' END, CASE WHEN has_invalid THEN 'invalid_frame' END,
    CASE WHEN jumped THEN 'timestamp_discontinuity' END, CASE WHEN ambiguous THEN 'identity_ambiguity' END, CASE WHEN unsure THEN 'low_confidence' END], lambda x: x IS NOT NULL)) AS why FROM named),
decided AS (SELECT * EXCLUDE (why), CASE WHEN len(why) = 0 THEN 'interpolate_linear' ELSE 'preserve_missing' END AS decision, CASE WHEN len(why) = 0 THEN ['eligible_short_internal_gap'] ELSE why END AS reasons FROM reasoned)"""
