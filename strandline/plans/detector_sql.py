"""The event detector as SQL: one recursive step a frame for all recordings at once, each step naming what happens and then what follows from it."""

from __future__ import annotations

from ..operators.events import Limits
from .bindings import FRAMES


def detector_sql(c: Limits) -> str:
    """Common table expressions from frames to `found`: the events that detect_events gives, those at the end of a sequence included."""
    here = "{'k': k, 't': t}"
    held = "b IN ('arm', 'record', 'keep', 'final', 'active', 'resume')"
    cleared = "(b = 'inactive' OR b LIKE 'end%')"
    return f"""{FRAMES},
seen AS (SELECT rec, t, row_number() OVER (PARTITION BY rec ORDER BY t) - 1 AS k, h0 AS hand, NOT invalid AS ok, q AS motion FROM (SELECT *, row_number() OVER (PARTITION BY rec, t ORDER BY h0, NOT invalid, q) AS first FROM frames) WHERE first = 1),
walk AS (
  SELECT rec, -1::BIGINT AS k, 'inactive' AS mode, NULL::BIGINT AS smooth, []::STRUCT(k BIGINT, t BIGINT)[] AS roll, NULL::BIGINT AS armed, NULL::STRUCT(k BIGINT, t BIGINT) AS start, NULL::STRUCT(k BIGINT, t BIGINT) AS usable, NULL::STRUCT(k BIGINT, t BIGINT) AS active, NULL::BIGINT AS quiet, 0::BIGINT AS gap, NULL::BIGINT AS calm, NULL::STRUCT(k BIGINT, t BIGINT) AS ends, '' AS reason, NULL::STRUCT(k BIGINT, t BIGINT) AS began
  FROM (SELECT DISTINCT rec FROM seen)
  UNION ALL
  SELECT rec, k,
    CASE WHEN b = 'arm' THEN 'arming' WHEN b = 'inactive' THEN 'inactive' WHEN b IN ('record', 'resume') THEN 'recording' WHEN b = 'final' THEN 'finalizing' WHEN b LIKE 'end%' THEN 'cooldown' ELSE mode END,
    CASE WHEN b = 'reset' THEN 0 WHEN b IN ('drop', 'inactive') THEN NULL ELSE s END,
    CASE WHEN b = 'reset' THEN [{here}] WHEN b IN ('arm', 'roll') THEN rolled WHEN b = 'drop' OR {cleared} THEN [] ELSE roll END,
    CASE WHEN b = 'arm' THEN t WHEN {cleared} THEN NULL ELSE armed END,
    CASE WHEN b = 'arm' THEN rolled[1] WHEN {cleared} THEN NULL ELSE start END,
    CASE WHEN b IN ('reset', 'roll') OR {held} THEN {here} WHEN b = 'drop' OR {cleared} THEN NULL ELSE usable END,
    CASE WHEN b IN ('record', 'active', 'resume') THEN {here} WHEN {cleared} THEN NULL ELSE active END,
    CASE WHEN b = 'final' THEN t WHEN b = 'resume' OR {cleared} THEN NULL ELSE quiet END,
    CASE WHEN {held} OR {cleared} THEN 0 WHEN b = 'gap' THEN gap + 1 ELSE gap END,
    CASE WHEN b = 'cool' THEN calmed WHEN b LIKE 'end%' AND still_now THEN t WHEN b IN ('cool', 'inactive') OR b LIKE 'end%' THEN NULL ELSE calm END,
    CASE WHEN b IN ('end_gap', 'end_late') THEN usable WHEN b = 'end_full' THEN {here} WHEN b = 'end_settled' THEN active END,
    CASE b WHEN 'end_gap' THEN 'signal_gap' WHEN 'end_late' THEN 'max_duration' WHEN 'end_full' THEN 'max_duration' WHEN 'end_settled' THEN 'settled' ELSE '' END, start
  FROM (SELECT *, CASE
      WHEN mode = 'inactive' THEN CASE WHEN u AND t - usable.t > {c.gap_time} THEN 'reset' WHEN u AND loud THEN 'arm' WHEN u THEN 'roll' WHEN NOT hand THEN 'drop' ELSE 'same' END
      WHEN mode = 'cooldown' THEN CASE WHEN t - calmed >= {c.cooldown} THEN 'inactive' ELSE 'cool' END
      WHEN mode = 'arming' THEN CASE WHEN broken OR (u AND still) THEN 'inactive' WHEN u AND t - armed >= {c.arming} THEN 'record' WHEN u THEN 'keep' ELSE 'gap' END
      WHEN broken THEN 'end_gap' WHEN t > start.t + {c.most_event} THEN 'end_late' WHEN NOT u THEN 'gap' WHEN t = start.t + {c.most_event} THEN 'end_full'
      WHEN mode = 'recording' THEN CASE WHEN still THEN 'final' ELSE 'active' END
      WHEN t - quiet >= {c.finalization} THEN 'end_settled' WHEN loud THEN 'resume' ELSE 'keep' END AS b
    FROM (SELECT *, coalesce(s >= {c.start_motion}, FALSE) AS loud, coalesce(s <= {c.stop_motion}, FALSE) AS still, ok AND (NOT hand OR (u AND coalesce(s <= {c.stop_motion}, FALSE))) AS still_now,
        CASE WHEN ok AND (NOT hand OR (u AND coalesce(s <= {c.stop_motion}, FALSE))) THEN coalesce(calm, t) END AS calmed,
        list_filter(list_append(roll, {here}), lambda x: t - x.t <= {c.pre_roll}) AS rolled, gap + (NOT u)::BIGINT > {c.gap_frames} OR t - coalesce(usable.t, start.t) > {c.gap_time} AS broken
      FROM (SELECT w.* EXCLUDE (k), o.k, o.t, hand, ok, hand AND ok AND motion <= {c.most_motion} AS u,
          CASE WHEN hand AND ok AND motion <= {c.most_motion} THEN coalesce(({c.alpha_ppm} * motion + {1_000_000 - c.alpha_ppm} * smooth + 500000) // 1000000, motion) ELSE smooth END AS s
        FROM walk w JOIN seen o ON o.rec = w.rec AND o.k = w.k + 1)))),
at_end AS (SELECT *, row_number() OVER (PARTITION BY rec ORDER BY k DESC) AS back FROM walk),
found AS (SELECT rec, began.k AS first_index, ends.k AS last_index, began.t AS first_t, ends.t AS last_t, reason FROM walk WHERE reason <> '' AND ends.t - began.t >= {c.least_event}
  UNION ALL SELECT rec, start.k, e.k, start.t, e.t, 'stream_end' FROM (SELECT *, CASE mode WHEN 'recording' THEN usable WHEN 'finalizing' THEN active END AS e FROM at_end WHERE back = 1) WHERE e.t - start.t >= {c.least_event})"""
