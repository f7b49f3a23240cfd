"""Structured Streaming forms: the same transition function as in batch, windows with watermarks, idempotent appends."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.events import EVENT_SCHEMA, Limits, State, finish, step


def detect_events_stream(observations: DataFrame, limits: Limits = Limits(), idle_ms: int = 60_000, late: str = "side", event_time: str = "at") -> DataFrame:
    """Events of a stream of (rec, t, hand_present, quality_ok, motion_q, at) with a watermark on at.

    Rows are put in order within a micro-batch. Rows at or before a sequence's last time are late: `drop` leaves them out, `side` emits
    each as a row with reason `late` (first_t = last_t = its time). When event time has passed a sequence by idle_ms, its open
    event closes as `stream_end` and the state goes.
    """
    names = [x.split()[0] for x in EVENT_SCHEMA.split(", ")]

    def update(key: tuple, batches: Iterator[pd.DataFrame], held: GroupState) -> Iterator[pd.DataFrame]:
        state = State.of(held.get[0] if held.exists else None)
        out: list[tuple] = []
        if held.hasTimedOut:
            last = finish(state, limits)
            held.remove()
            out += [(key[0], *last)] if last else []
        else:
            rows = pd.concat(list(batches), ignore_index=True).sort_values(["t", "hand_present", "quality_ok", "motion_q"])
            for t, hand, ok, motion in rows[["t", "hand_present", "quality_ok", "motion_q"]].itertuples(index=False):
                if state.t is not None and t <= state.t:
                    if late == "side":
                        out.append((key[0], None, None, int(t), int(t), "late"))
                    continue
                event = step(state, limits, int(t), bool(hand), bool(ok), int(motion))
                out += [(key[0], *event)] if event else []
            held.update((state.text(),))
            held.setTimeoutTimestamp(max(held.getCurrentWatermarkMs() + 1, int(rows[event_time].max().timestamp() * 1000) + idle_ms))
        yield pd.DataFrame(out, columns=names)

    return observations.groupBy("rec").applyInPandasWithState(update, EVENT_SCHEMA, "state string", "append", GroupStateTimeout.EventTimeTimeout)


def project_observations_stream(frames: DataFrame, event_time: str = "at", idle_ms: int = 3_600_000) -> DataFrame:
    """Frames (rec, i, t, invalid, p0, x0, y0, p1, x1, y1, at) as observations, coordinates being palms in millionths: the last valid frame of a sequence is its state."""
    schema = "rec bigint, i bigint, t bigint, hand_present boolean, quality_ok boolean, motion_q bigint, at timestamp"
    columns = ["i", "t", "invalid", "p0", "x0", "y0", "p1", "x1", "y1", event_time]

    def update(key: tuple, batches: Iterator[pd.DataFrame], held: GroupState) -> Iterator[pd.DataFrame]:
        if held.hasTimedOut:
            held.remove()
            return
        last = held.get if held.exists else None
        out = []
        for i, t, invalid, p0, x0, y0, p1, x1, y1, at in pd.concat(list(batches)).sort_values("i")[columns].itertuples(index=False):
            motion = 0
            if not invalid:
                if last is not None and t > last[0]:
                    took = int(t - last[0])
                    speeds = [(int(abs(x - last[k + 1]) + abs(y - last[k + 2])) * 1_000_000 + took // 2) // took for k, (p, x, y) in ((1, (p0, x0, y0)), (4, (p1, x1, y1))) if p and last[k]]
                    motion = max([0, *speeds])
                last = (int(t), bool(p0), int(x0), int(y0), bool(p1), int(x1), int(y1))
            out.append((key[0], i, t, bool(not invalid and (p0 or p1)), not invalid, motion, at))
        if last is not None:
            held.update(last)
            held.setTimeoutTimestamp(max(held.getCurrentWatermarkMs() + 1, int(out[-1][-1].timestamp() * 1000) + idle_ms))
        yield pd.DataFrame(out, columns=[x.split()[0] for x in schema.split(", ")])

    state = "t bigint, p0 boolean, x0 bigint, y0 bigint, p1 boolean, x1 bigint, y1 bigint"
    return frames.groupBy("rec").applyInPandasWithState(update, schema, state, "append", GroupStateTimeout.EventTimeTimeout)


def quality_windows(frames: DataFrame, kind: str, width: str, present: Column, invalid: Column, event_time: str = "at", slide: str | None = None, by: str = "rec") -> DataFrame:
    """(rec, start, end, frames, valid, seen) per tumbling, sliding or session window; on a stream set a watermark before."""
    w = F.session_window(event_time, width) if kind == "session" else F.window(event_time, width, slide) if kind == "sliding" else F.window(event_time, width)
    found = frames.groupBy(by, w.alias("w")).agg(F.count("*").alias("frames"), F.count_if(~invalid).alias("valid"), F.count_if(present).alias("seen"))
    return found.select(by, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "frames", "valid", "seen")


def split_attempts(batch: DataFrame, ledger: DataFrame, key: str, content: str, source: str) -> DataFrame:
    """Adds status to a batch: new, unchanged (same key and content), or conflict (other content, or another key's source).

    Within the batch the first row of a key by content counts, and a source's first key.
    """
    from pyspark.sql import Window

    known = ledger.select(F.col(key).alias("_k"), F.col(content).alias("_c")).distinct()
    owner = ledger.groupBy(F.col(source).alias("_s")).agg(F.min(key).alias("_owner"))
    first_content = F.first(content).over(Window.partitionBy(key).orderBy(content))
    first_key = F.first(key).over(Window.partitionBy(source).orderBy(key))
    own = batch.withColumn("_fc", first_content).withColumn("_fk", first_key)
    joined = own.join(known, F.col(key) == F.col("_k"), "left").join(owner, F.col(source) == F.col("_s"), "left")
    other = (F.col("_owner").isNotNull() & (F.col("_owner") != F.col(key))) | (F.col("_owner").isNull() & (F.col("_fk") != F.col(key)))
    status = F.when(F.col("_k").isNotNull() & (F.col("_c") == F.col(content)), "unchanged").when(F.col("_k").isNotNull() | other | (F.col("_fc") != F.col(content)), "conflict").otherwise("new")
    return joined.withColumn("status", status).drop("_k", "_c", "_s", "_owner", "_fc", "_fk")


def append_attempts(stream: DataFrame, ledger_path: str, conflicts_path: str, checkpoint: str, key: str, content: str, source: str):
    """A query that appends new rows to a Parquet ledger and conflicts to another, in folders named by batch, so that a replayed batch writes the same folder."""

    def each(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        ledger = spark.read.schema(batch.schema).option("recursiveFileLookup", "true").option("pathGlobFilter", "*.parquet").parquet(ledger_path)
        own = f"/batch-{batch_id:010d}/"
        before = ledger.where(~F.input_file_name().contains(own))
        marked = split_attempts(batch.dropDuplicates([key, content, source]), before, key, content, source)
        marked.where("status = 'new'").drop("status").write.mode("overwrite").parquet(f"{ledger_path}{own}")
        marked.where("status = 'conflict'").write.mode("overwrite").parquet(f"{conflicts_path}{own}")

    spark = stream.sparkSession
    spark.createDataFrame([], stream.schema).write.mode("append").parquet(f"{ledger_path}/empty")
    return stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint)


def intake_packages(packages: DataFrame, fields: tuple[str, ...], text: str = "payload") -> DataFrame:
    """One row per package text: digest, status (accepted, malformed, unknown_field, missing_field) and its fields; never eligible for training.

    A batch or a stream with a watermark; duplicates by digest are left to dropDuplicates on the result.
    """
    parsed = packages.withColumn("_keys", F.json_object_keys(text)).withColumn("digest", F.sha2(F.col(text).cast("binary"), 256))
    known = F.array(*map(F.lit, fields))
    # inside brackets, text after the object makes the whole invalid or a second element
    alone = F.coalesce(F.json_array_length(F.concat(F.lit("["), F.col(text), F.lit("]"))) == 1, F.lit(False))
    bad = F.try_parse_json(text).isNull() | F.col("_keys").isNull() | ~alone
    status = F.when(bad, "malformed").when(F.size(F.array_except("_keys", known)) > 0, "unknown_field").when(F.size(F.array_except(known, "_keys")) > 0, "missing_field").otherwise("accepted")
    return parsed.select("*", status.alias("status"), F.lit(False).alias("eligible_for_training")).drop("_keys")

