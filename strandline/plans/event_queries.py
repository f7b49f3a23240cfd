"""Queries of events and streams. A stream reads the frames from written files; its result is what its sink holds at the end."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import events as E
from ..operators import quality as Q
from ..sources.staging import new_path, written
from ..streaming import live as L
from ..streaming.ledger import write_ledger
from ..streaming.buffers import events_with_frames_stream, list_state
from .bindings import FRAMES, HOUR, frames, palm_q, point, table
from .detector_sql import detector_sql

#: Hours for the sparse test events where the defaults have milliseconds; motion is a value in millionths.
LIMITS = E.Limits(start_motion=60_000_000, stop_motion=20_000_000, most_motion=400_000_000, pre_roll=20 * HOUR, arming=5 * HOUR, least_event=20 * HOUR, most_event=400 * HOUR, finalization=20 * HOUR, gap_frames=2, gap_time=40 * HOUR, cooldown=15 * HOUR)


def observations(spark: SparkSession, sf: str) -> DataFrame:
    f = frames(spark, sf)
    return f.select("rec", "i", "t", F.col("h0").alias("hand_present"), (~F.col("invalid")).alias("quality_ok"), F.col("q").alias("motion_q"), F.timestamp_micros("us").alias("at"))


def _streamed(rows: DataFrame, transform, name: str) -> DataFrame:
    """rows written, read as a stream with a watermark, transformed, and what the file sink has when all is read."""
    spark = rows.sparkSession
    source, sink, marks = (new_path(spark, f"{name}-{x}") for x in ("in", "out", "marks"))
    rows.write.parquet(source)
    stream = spark.readStream.schema(rows.schema).parquet(source).withWatermark("at", "1 hour")
    out = transform(stream)
    out.writeStream.format("parquet").option("path", sink).option("checkpointLocation", marks).outputMode("append").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(out.schema).parquet(sink)


def i2_events(spark: SparkSession, sf: str) -> DataFrame:
    return E.detect_events(observations(spark, sf), LIMITS)


def i2_stream_events(spark: SparkSession, sf: str) -> DataFrame:
    found = _streamed(observations(spark, sf), lambda s: L.detect_events_stream(s, LIMITS, idle_ms=10**12), "events")
    return found.where("reason <> 'late'")


I2 = f"WITH RECURSIVE {detector_sql(LIMITS)} SELECT * FROM found"
I2B = f"WITH RECURSIVE {detector_sql(LIMITS)} SELECT * FROM found WHERE reason <> 'stream_end'"


def _in_slices(rows: DataFrame, transform, name: str, slices: int = 4) -> DataFrame:
    """Each recording's rows streamed in so many batches, then a heartbeat of recording -1 that ends all sequences; what the sink has in the end."""
    spark = rows.sparkSession
    source, sink, marks = (new_path(spark, f"{name}-{x}") for x in ("in", "out", "marks"))
    dealt = written(rows.withColumn("_slice", F.ntile(slices).over(Window.partitionBy("rec").orderBy("i"))), f"{name}-dealt")
    beat = rows.limit(1).withColumns({"rec": F.lit(-1).cast("bigint"), "at": F.timestamp_seconds(F.lit(9 * 10**9))})
    for part in (*(dealt.where(F.col("_slice") == k + 1).drop("_slice") for k in range(slices)), beat, beat):
        part.coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema(rows.schema).parquet(source).withWatermark("at", "40000 days")
        out = transform(stream)
        with list_state(spark):
            out.writeStream.format("parquet").option("path", sink).option("checkpointLocation", marks).outputMode("append").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(out.schema).parquet(sink).where("rec >= 0")


def i3_stream_end(spark: SparkSession, sf: str) -> DataFrame:
    """All events of a stream whose sequences come in four batches, those that its end closes included."""
    found = _in_slices(observations(spark, sf), lambda s: L.detect_events_stream(s, LIMITS, idle_ms=10**12), "ends")
    return found.where("reason <> 'late'")


def i6_stream_frames(spark: SparkSession, sf: str) -> DataFrame:
    """Events of a stream with their frames, from buffers that hold what an event can still need."""
    return _in_slices(observations(spark, sf), lambda s: events_with_frames_stream(s, ("i",), LIMITS, idle_ms=10**12), "buffers")


I6B = f"WITH RECURSIVE {detector_sql(LIMITS)} SELECT e.*, f.t AS frame_t, f.i AS frame_i FROM found e JOIN frames f ON f.rec = e.rec AND f.t BETWEEN e.first_t AND e.last_t"


def i4_late_rows(spark: SparkSession, sf: str) -> DataFrame:
    """The frames stream in, and a tenth of them again afterwards, a microsecond earlier: late rows by the detector's own rule."""
    rows = observations(spark, sf)
    source, sink, marks = (new_path(spark, f"late-{x}") for x in ("in", "out", "marks"))
    again = rows.where("i % 10 = 3").withColumn("t", F.col("t") - 1)
    schema = None
    for part in (rows, again):
        part.write.mode("append").parquet(source)
        # event time doesn't run out, so that no row is dropped before the detector sees it
        stream = spark.readStream.schema(rows.schema).parquet(source).withWatermark("at", "40000 days")
        found = L.detect_events_stream(stream, LIMITS, idle_ms=10**12, late="side")
        found.writeStream.format("parquet").option("path", sink).option("checkpointLocation", marks).outputMode("append").trigger(availableNow=True).start().awaitTermination()
        schema = found.schema
    return spark.read.schema(schema).parquet(sink).where("reason = 'late'").select("rec", F.col("first_t").alias("t"))


I4 = f"""WITH {FRAMES} SELECT rec, t - 1 AS t FROM frames WHERE i % 10 = 3
UNION ALL SELECT rec, t FROM (SELECT rec, t, row_number() OVER (PARTITION BY rec, t ORDER BY i) AS k FROM frames) WHERE k > 1"""


def i1_stream_observations(spark: SparkSession, sf: str) -> DataFrame:
    f = frames(spark, sf).withColumn("t", F.expr("t div 1000000"))
    f = f.select("rec", "i", "t", "invalid", F.col("h0").alias("p0"), palm_q(0).alias("x0"), palm_q(0, 1).alias("y0"), F.col("h1").alias("p1"), palm_q(30).alias("x1"), palm_q(30, 1).alias("y1"), F.timestamp_micros("us").alias("at"))
    return _streamed(f, L.project_observations_stream, "observations").drop("at")


def i9_quality_windows(spark: SparkSession, sf: str) -> DataFrame:
    f = frames(spark, sf).withColumn("at", F.timestamp_micros("us"))
    w = L.quality_windows(f, "tumbling", "5 days", F.col("h0"), F.col("invalid"))
    return w.select("rec", F.unix_micros("start").alias("start"), "frames", "valid", "seen")


I9 = f"WITH {FRAMES} SELECT rec, us // {120 * HOUR} * {120 * HOUR} AS start, count(*) AS frames, count(*) FILTER (NOT invalid) AS valid, count(*) FILTER (h0) AS seen FROM frames GROUP BY 1, 2"


def i9_streamed_windows(spark: SparkSession, sf: str) -> DataFrame:
    """The tumbling windows from a stream in append mode. Rows of a recording of its own, far later, move the watermark past all windows, which closes them."""
    f = frames(spark, sf).select("rec", "h0", "invalid", F.timestamp_micros("us").alias("at"))
    source, sink, marks = (new_path(spark, f"windows-{x}") for x in ("in", "out", "marks"))
    end = f.agg(F.max("at").alias("at")).select(F.lit(-1).cast("bigint").alias("rec"), F.lit(False).alias("h0"), F.lit(False).alias("invalid"), (F.col("at") + F.expr("INTERVAL 3650 DAYS")).alias("at"))
    for part in (f, end):
        part.select(*f.columns).write.mode("append").parquet(source)
        stream = spark.readStream.schema(f.schema).parquet(source).withWatermark("at", "1 hour")
        w = L.quality_windows(stream, "tumbling", "5 days", F.col("h0"), F.col("invalid"))
        w.writeStream.format("parquet").option("path", sink).option("checkpointLocation", marks).outputMode("append").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(w.schema).parquet(sink).where("rec <> -1").select("rec", F.unix_micros("start").alias("start"), "frames", "valid", "seen")


def i9_session_windows(spark: SparkSession, sf: str) -> DataFrame:
    f = frames(spark, sf).withColumn("at", F.timestamp_micros("us"))
    w = L.quality_windows(f, "session", "12 hours", F.col("h0"), F.col("invalid"))
    return w.select("rec", F.unix_micros("start").alias("start"), "frames", "valid", "seen")


I9B = f"""WITH {FRAMES}, s AS (SELECT *, us - lag(us) OVER (PARTITION BY rec ORDER BY us, event_id) >= {12 * HOUR} AS opens FROM frames), n AS (SELECT *, sum(coalesce(opens, FALSE)::INT) OVER (PARTITION BY rec ORDER BY us, event_id) AS w FROM s)
SELECT rec, min(us) AS start, count(*) AS frames, count(*) FILTER (NOT invalid) AS valid, count(*) FILTER (h0) AS seen FROM n GROUP BY rec, w"""


def i9_sliding_windows(spark: SparkSession, sf: str) -> DataFrame:
    f = frames(spark, sf).withColumn("at", F.timestamp_micros("us"))
    w = L.quality_windows(f, "sliding", "4 days", F.col("h0"), F.col("invalid"), slide="2 days")
    return w.select("rec", F.unix_micros("start").alias("start"), "frames", "valid", "seen")


I9C = f"""WITH {FRAMES}, x AS (SELECT *, us // {48 * HOUR} * {48 * HOUR} - k * {48 * HOUR} AS start FROM frames, range(2) r(k)) SELECT rec, start, count(*) AS frames, count(*) FILTER (NOT invalid) AS valid, count(*) FILTER (h0) AS seen FROM x GROUP BY 1, 2"""


def i6_detected_frames(spark: SparkSession, sf: str) -> DataFrame:
    found = E.events_with_frames(i2_events(spark, sf), frames(spark, sf).select("rec", "i", "t"))
    return found.select("rec", "first_t", "last_t", "reason", F.col("t").alias("frame_t"), F.col("i").alias("frame_i"))


def i6_events_with_frames(spark: SparkSession, sf: str) -> DataFrame:
    f = frames(spark, sf)
    spans = f.where("kind = 'signup'").select("rec", F.col("t").alias("first_t"), (F.col("t") + 12 * HOUR).alias("last_t"), F.col("event_id").cast("string").alias("reason"))
    return E.events_with_frames(spans, f, before=2 * HOUR).select("rec", "i", F.col("reason").alias("event"))


I6 = f"WITH {FRAMES} SELECT f.rec, f.i, e.event_id::VARCHAR AS event FROM frames e JOIN frames f ON e.rec = f.rec AND f.t >= e.t - {2 * HOUR} AND f.t <= e.t + {12 * HOUR} WHERE e.kind = 'signup'"


def i5_tracked(spark: SparkSession, sf: str) -> DataFrame:
    f = frames(spark, sf)
    mean = lambda base, axis: sum((point(k=base + k, axis=axis) for k in (5, 9, 13, 17)), point(k=base, axis=axis)) / 5
    hand = lambda k, base: F.struct(F.lit(k).alias("k"), *(point(k=base, axis=a).alias(c) for a, c in enumerate("xyz")), *(mean(base, a).alias(f"palm_{c}") for a, c in enumerate("xyz")), F.col(f"h{k}").alias("p"))
    d = f.select("rec", "i", F.explode(F.array(hand(0, 0), hand(1, 50))).alias("d"), F.when(F.col("event_id") % 3 == 0, "left").otherwise("right").alias("label"))
    return E.track_identities(d.where("d.p").select("rec", "i", "label", "d.*").drop("p"), E.Tracking(most_cost=1.0)).select("rec", "i", "k", "x", "y", "label", "slot")


def e10_batch_motion(spark: SparkSession, sf: str) -> DataFrame:
    found = i2_events(spark, sf)
    return found.groupBy("reason").agg(F.count("*").alias("events"), F.sum(F.col("last_index") - F.col("first_index") + 1).alias("frames"))


def i7_attempt_status(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events").select("event_id", "user_id", F.col("event_type").alias("content"), F.concat_ws("/", "user_id", F.col("event_id") % 500).alias("source"))
    ledger = e.where("event_id % 3 = 0")
    batch = e.where("event_id % 2 = 0").withColumn("content", F.when(F.col("event_id") % 18 == 0, "changed").otherwise(F.col("content")))
    return L.split_attempts(batch, ledger, "event_id", "content", "source").groupBy("status").agg(F.count("*").alias("n"))


I7 = """WITH e AS (SELECT event_id, event_type AS content, user_id || '/' || event_id % 500 AS source FROM events), l AS (SELECT * FROM e WHERE event_id % 3 = 0), o AS (SELECT source, min(event_id) AS owner FROM l GROUP BY 1),
b AS (SELECT event_id, CASE WHEN event_id % 18 = 0 THEN 'changed' ELSE content END AS content, source, min(event_id) OVER (PARTITION BY source) AS first_key FROM e WHERE event_id % 2 = 0),
s AS (SELECT CASE WHEN l.event_id IS NOT NULL AND l.content = b.content THEN 'unchanged' WHEN l.event_id IS NOT NULL OR (owner IS NOT NULL AND owner <> b.event_id) OR (owner IS NULL AND first_key <> b.event_id) THEN 'conflict' ELSE 'new' END AS status FROM b LEFT JOIN l ON l.event_id = b.event_id LEFT JOIN o ON o.source = b.source)
SELECT status, count(*) AS n FROM s GROUP BY 1"""


def i7_streamed_ledger(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "events").select("event_id", F.col("event_type").alias("content"), F.concat_ws("/", "user_id", "event_id").alias("source"))
    source, ledger, conflicts, marks = (new_path(spark, f"ledger-{x}") for x in ("in", "rows", "conflicts", "marks"))
    rows.write.parquet(source)
    stream = spark.readStream.schema(rows.schema).parquet(source)
    L.append_attempts(stream, ledger, conflicts, marks, "event_id", "content", "source").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(rows.schema).option("recursiveFileLookup", "true").parquet(ledger)


I7B = "SELECT event_id, event_type AS content, user_id || '/' || event_id AS source FROM events"


def i7_keyed_ledger(spark: SparkSession, sf: str) -> DataFrame:
    """Events as attempts in two batches; then, in one, some of them again, some with another content, some keys with another's source. The ledger's rows and how often each status came."""
    rows = table(spark, sf, "events").select("event_id", F.col("event_type").alias("content"), F.concat_ws("/", "user_id", "event_id").alias("source"))
    again = rows.where("event_id % 10 = 4")
    changed = rows.where("event_id % 10 = 5").withColumn("content", F.lit("changed"))
    taken = rows.where("event_id % 10 = 6").withColumn("event_id", F.col("event_id") + 10_000_000_000)
    source, ledger, marks = (new_path(spark, f"keyed-{x}") for x in ("in", "rows", "marks"))
    for part in (*(rows.where(F.pmod("event_id", F.lit(2)) == k) for k in range(2)), again.unionAll(changed).unionAll(taken)):
        part.write.mode("append").parquet(source)
        stream = spark.readStream.schema(rows.schema).parquet(source)
        with list_state(spark):
            write_ledger(stream, ledger, marks, "event_id", "content", "source").outputMode("append").trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(ledger).select("event_id", "content", "source", F.col("status").cast("string").alias("status"))


I7C = """WITH e AS (SELECT event_id, event_type AS content, user_id || '/' || event_id AS source FROM events) SELECT *, 'new' AS status FROM e UNION ALL SELECT *, 'unchanged' FROM e WHERE event_id % 10 = 4
UNION ALL SELECT event_id, 'changed', source, 'conflict' FROM e WHERE event_id % 10 = 5 UNION ALL SELECT event_id + 10000000000, content, source, 'conflict' FROM e WHERE event_id % 10 = 6"""


def i8_packages(spark: SparkSession, sf: str) -> DataFrame:
    broken = F.when(F.col("event_id") % 7 == 0, F.concat("props", F.lit("x"))).when(F.col("event_id") % 11 == 0, F.lit('{"z": 1}')).when(F.col("event_id") % 13 == 0, F.lit("{}")).otherwise(F.col("props"))
    return L.intake_packages(table(spark, sf, "events").select("event_id", broken.alias("payload")), ("k",)).select("event_id", "digest", "status", "eligible_for_training")


I8 = """SELECT event_id, sha256(p) AS digest, CASE WHEN event_id % 7 = 0 THEN 'malformed' WHEN event_id % 11 = 0 THEN 'unknown_field' WHEN event_id % 13 = 0 THEN 'missing_field' ELSE 'accepted' END AS status, FALSE AS eligible_for_training
FROM (SELECT event_id, CASE WHEN event_id % 7 = 0 THEN props || 'x' WHEN event_id % 11 = 0 THEN '{"z": 1}' WHEN event_id % 13 = 0 THEN '{}' ELSE props END AS p FROM events)"""


def _b7_sql() -> str:
    from .sequence_queries import B7

    return B7


QUERIES = {
    "i1_stream_observations": (i1_stream_observations, _b7_sql()), "i2_events": (i2_events, I2), "i2_stream_events": (i2_stream_events, I2B), "i3_stream_end": (i3_stream_end, I2), "i6_stream_frames": (i6_stream_frames, I6B), "i6_detected_frames": (i6_detected_frames, I6B.replace("e.*", "e.* EXCLUDE (first_index, last_index)")), "i4_late_rows": (i4_late_rows, I4), "i5_tracked": (i5_tracked, None), "i6_events_with_frames": (i6_events_with_frames, I6),
    "i7_attempt_status": (i7_attempt_status, I7), "i7_streamed_ledger": (i7_streamed_ledger, I7B), "i7_keyed_ledger": (i7_keyed_ledger, I7C), "i8_packages": (i8_packages, I8), "i9_quality_windows": (i9_quality_windows, I9), "i9_streamed_windows": (i9_streamed_windows, I9), "i9_session_windows": (i9_session_windows, I9B), "i9_sliding_windows": (i9_sliding_windows, I9C), "i2_event_reasons": (e10_batch_motion, f"WITH RECURSIVE {detector_sql(LIMITS)} SELECT reason, count(*) AS events, sum(last_index - first_index + 1)::BIGINT AS frames FROM found GROUP BY 1"),
}
