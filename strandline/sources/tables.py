"""Typed scans and sinks of the governed tables and sequences."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.scalars import content_path
from ..operators.digests import multiset_digest, row_text

POINT = T.ArrayType(T.StructType([T.StructField("x", T.DoubleType()), T.StructField("y", T.DoubleType()), T.StructField("z", T.DoubleType()), T.StructField("visibility", T.DoubleType()), T.StructField("presence", T.DoubleType())]))
HAND = T.StructType([T.StructField("slot_id", T.StringType()), T.StructField("present", T.BooleanType()), T.StructField("tracking_id", T.StringType()), T.StructField("detector_index", T.ShortType()), T.StructField("handedness", T.StringType()), T.StructField("handedness_confidence", T.DoubleType()), T.StructField("image_landmarks", POINT), T.StructField("world_landmarks", POINT)])
ANCHOR = T.StructType([T.StructField("name", T.StringType()), T.StructField("present", T.BooleanType()), T.StructField("image_point", POINT.elementType), T.StructField("world_point", POINT.elementType)])
FRAME = T.StructType([
    T.StructField("schema_version", T.StringType()), T.StructField("source_recording_id", T.StringType()), *(T.StructField(c, T.LongType()) for c in ("frame_index", "source_pts", "source_time_base_numerator", "source_time_base_denominator", "relative_timestamp_us", "task_timestamp_ms")),
    T.StructField("invalid", T.BooleanType()), T.StructField("invalid_reason", T.StringType()), T.StructField("hands", T.ArrayType(HAND)), T.StructField("body_anchors", T.ArrayType(ANCHOR)), T.StructField("observed_hand_count", T.ByteType()), T.StructField("observed_body_anchor_count", T.ByteType()),
])

#: The normalized tables whose columns are pinned, as DDL; the first column is the key.
SCHEMAS = {
    "participants": "participant_id string, handedness string",
    "sessions": "session_id string, participant_id string, device_id string, started_at timestamp, finished_at timestamp, capture_mode string, capture_software_version string, camera_facing string, frame_width_px bigint, frame_height_px bigint, frame_rate_numerator bigint, frame_rate_denominator bigint, rotation_degrees smallint, mirror_state string",
    "recordings": "recording_id string, participant_id string, session_id string, device_id string, captured_at timestamp, duration_us bigint, handedness string, mirror_state string, rotation_degrees smallint, audio_present boolean, media struct<artifact_id:string,sha256:string,size_bytes:bigint>, consent_grant struct<grant_id:string,receipt_id:string>",
    "clips": "clip_id string, participant_id string, session_id string, source_recording_id string, interval struct<start_us:bigint,end_us:bigint>, handedness string, mirror_state string, artifact struct<artifact_id:string,sha256:string,size_bytes:bigint>",
    "annotations": "annotation_id string, participant_id string, session_id string, source_recording_id string, clip_id string, interval struct<start_us:bigint,end_us:bigint>, disposition string, label_id string, other_kind string, reason_code string, review_status string, eligible_for_training boolean",
    "derived_artifacts": "derived_artifact_id string, derivation_kind string, parent_artifact_ids array<string>, participant_id string, session_id string, source_recording_id string, clip_id string, annotation_id string, sample_id string, label_id string, split_id string, partition string, handedness string, mirror_state string, operation_id string, operation_version string, artifact struct<artifact_id:string,sha256:string,size_bytes:bigint>",
}


class SchemaDrift(ValueError):
    """A table's columns or types aren't the pinned ones."""


def _check(found: T.StructType, pinned: T.StructType, name: str) -> None:
    kinds = lambda s: [(f.name, f.dataType.simpleString()) for f in s]
    if kinds(found) != kinds(pinned):
        odd = sorted(set(kinds(found)) ^ set(kinds(pinned)))
        raise SchemaDrift(f"{name}: {odd[:6] or 'column order'}")


class ContentDrift(ValueError):
    """A table's rows aren't those that its manifest tells of, or a value is missing where none may be."""


def table_manifest(df: DataFrame) -> dict:
    """{rows, digest} of a table's content, the same in any order and partitioning; source_file, which scan_frames adds, aside."""
    found = multiset_digest(df, row_text([c for c in df.columns if c != "source_file"])).first()
    return {"rows": found["rows"], "digest": found["digest"]}


def check_content(df: DataFrame, name: str, manifest: dict | None = None, required: tuple[str, ...] = ()) -> DataFrame:
    """df, if no required column has a null and, with a manifest, rows and digest are the manifest's; else ContentDrift. One pass, no sort.

    Required columns may be fields of structs, by their path.
    """
    if required:
        missing = df.agg(*(F.count_if(F.col(c).isNull()).alias(f"n{k}") for k, c in enumerate(required))).first()
        if odd := [c for k, c in enumerate(required) if missing[f"n{k}"]]:
            raise ContentDrift(f"{name}: nulls in {odd}")
    if manifest is not None and (found := table_manifest(df)) != {k: manifest[k] for k in ("rows", "digest")}:
        raise ContentDrift(f"{name}: {found['rows']} rows for {manifest['rows']}" if found["rows"] != manifest["rows"] else f"{name}: values differ")
    return df


#: What may not be null, besides the key: identities, bounds and digests.
REQUIRED = {
    "participants": ("participant_id", "handedness"), "sessions": ("session_id", "participant_id", "device_id", "started_at", "finished_at"), "recordings": ("recording_id", "participant_id", "session_id", "duration_us", "media.sha256"),
    "clips": ("clip_id", "source_recording_id", "interval.start_us", "interval.end_us"), "annotations": ("annotation_id", "clip_id", "disposition", "eligible_for_training"), "derived_artifacts": ("derived_artifact_id", "parent_artifact_ids", "artifact.sha256"),
    "frames": ("source_recording_id", "frame_index", "relative_timestamp_us", "invalid", "hands", "body_anchors"),
}


def scan_table(spark: SparkSession, path: str, name: str, manifest: dict | None = None) -> DataFrame:
    """One of the pinned tables; SchemaDrift if its columns, their order or types differ. With the manifest of what was written, also ContentDrift for changed, lost or added rows and nulls where none may be."""
    pinned = T.StructType.fromDDL(SCHEMAS[name])
    _check(spark.read.parquet(path).schema, pinned, name)
    found = spark.read.schema(pinned).parquet(path)
    return check_content(found, name, manifest, REQUIRED[name]) if manifest is not None else found


def write_table(df: DataFrame, path: str, key: str, rows_per_group: int = 65_536) -> None:
    """Rows in ranges of the key, sorted within each file; refuses an existing path and repeated or NULL keys (by a failing write)."""
    from pyspark.sql import Window

    repeated = F.count("*").over(Window.partitionBy(key)) > 1
    checked = df.withColumn("_bad", repeated | F.col(key).isNull()).withColumn(key, F.when(F.col("_bad"), F.raise_error(F.lit(f"{key} is repeated or missing")).cast(df.schema[key].dataType)).otherwise(F.col(key))).drop("_bad")
    checked.repartitionByRange(key).sortWithinPartitions(key).write.option("parquet.block.row.count.limit", rows_per_group).mode("errorifexists").parquet(path)


def scan_frames(spark: SparkSession, path: str, manifest: dict | None = None) -> DataFrame:
    """Frame sequences of all recordings under a folder, with source_file; SchemaDrift for other columns, and with a manifest ContentDrift as in scan_table."""
    _check(spark.read.parquet(path).schema, FRAME, "frames")
    found = spark.read.schema(FRAME).parquet(path).withColumn("source_file", F.col("_metadata.file_path"))
    return check_content(found, "frames", manifest, REQUIRED["frames"]) if manifest is not None else found


def write_frames(df: DataFrame, path: str, interchange: bool = False, points: int = 21) -> None:
    """Frames sorted by recording and index. With interchange an absent hand's landmarks are `points` NULL points instead of NULL."""
    if interchange:
        fill = lambda h, c: F.when(h[c].isNull(), F.array_repeat(F.lit(None).cast(POINT.elementType), points)).otherwise(h[c])
        df = df.withColumn("hands", F.transform("hands", lambda h: h.withField("image_landmarks", fill(h, "image_landmarks")).withField("world_landmarks", fill(h, "world_landmarks"))))
    df.select(*FRAME.names).repartition("source_recording_id").sortWithinPartitions("source_recording_id", "frame_index").write.mode("errorifexists").parquet(path)


def hash_inventory(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """(path, size_bytes, sha256) of every file below a folder, without empty ones, which Spark's reader leaves out. Files are read whole, 2 GB at most each."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", glob).load(path)
    return files.select("path", F.col("length").alias("size_bytes"), F.sha2("content", 256).alias("sha256"))


def write_members(df: DataFrame, path: str, name: str, content: str, per_file: int = 10_000) -> None:
    """Named contents (text or bytes) as members of archive files of at most per_file each: Parquet rows of (name, content), as no folder can hold a file for each of many small ones. Refuses an existing path."""
    members = df.select(F.col(name).alias("name"), F.col(content).cast("binary").alias("content"))
    members.write.option("maxRecordsPerFile", per_file).option("parquet.block.size", 16 << 20).mode("errorifexists").parquet(path)


def hash_members(spark: SparkSession, path: str) -> DataFrame:
    """(path, size_bytes, sha256) of every member of the archives that write_members made below a folder; a path is that of the archive with the member's name behind it."""
    members = spark.read.schema("name string, content binary").option("recursiveFileLookup", "true").parquet(path)
    return members.select(F.concat_ws("/", F.col("_metadata.file_path"), F.col("name")).alias("path"), F.octet_length("content").cast("bigint").alias("size_bytes"), F.sha2("content", 256).alias("sha256"))


def verify_artifacts(declared: DataFrame, inventory: DataFrame, name: str = "name") -> DataFrame:
    """(name, status): declared (name, size_bytes, sha256) against files by base name: verified, missing, size_differs, digest_differs, undeclared."""
    found = inventory.select(F.element_at(F.split("path", "/"), -1).alias("_n"), F.col("size_bytes").alias("_s"), F.col("sha256").alias("_h"))
    joined = declared.join(found, F.col(name) == F.col("_n"), "full")
    status = F.when(F.col(name).isNull(), "undeclared").when(F.col("_n").isNull(), "missing").when(F.col("size_bytes") != F.col("_s"), "size_differs").when(F.col("sha256") != F.col("_h"), "digest_differs").otherwise("verified")
    return joined.select(F.coalesce(name, "_n").alias(name), status.alias("status"))


def resolve_artifacts(registered: DataFrame, found: DataFrame, key: str, locator: str) -> DataFrame:
    """(key, availability): registered locators against found paths by base name: not_recorded, missing, available or ambiguous."""
    base = lambda c: F.element_at(F.split(F.regexp_replace(c, r"\\", "/"), "/"), -1)
    n = found.groupBy(base(F.col("path")).alias("_b")).agg(F.count("*").alias("_n"))
    joined = registered.join(n, base(F.col(locator)) == F.col("_b"), "left")
    return joined.select(key, F.when(F.col(locator).isNull(), "not_recorded").when(F.col("_n").isNull(), "missing").when(F.col("_n") == 1, "available").otherwise("ambiguous").alias("availability"))


def scan_json_packages(spark: SparkSession, path: str) -> DataFrame:
    """(path, payload) of every JSON document below a folder, each file one row; check them with streaming.live.intake_packages."""
    return spark.read.option("wholetext", "true").option("recursiveFileLookup", "true").text(path).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("payload"))


def json_violations(packages: DataFrame, fields: tuple[str, ...]) -> DataFrame:
    """(rule_id, path) of scanned documents: not_strict_json (not one object, a key told twice, a number that isn't finite), else unknown_field and missing_field."""
    keys = F.json_object_keys("payload")
    known = F.array(*map(F.lit, fields))
    loose = F.try_parse_json("payload").isNull() | keys.isNull()
    rules = F.array_compact(F.array(
        F.when(loose, F.lit("not_strict_json")), F.when(~loose & (F.size(F.array_except(keys, known)) > 0), F.lit("unknown_field")),
        F.when(~loose & (F.size(F.array_except(known, keys)) > 0), F.lit("missing_field")),
    ))
    return packages.select(F.explode(rules).alias("rule_id"), "path")


def build_media_table(members: DataFrame, labels: DataFrame, domain: str = "media/1") -> DataFrame:
    """(sample_id, recording_id, signer_id, label, split, size_bytes) of archive members (signer, recording, category, split, size_bytes), labels by an alias table."""
    from ..functions.scalars import opaque_id

    named = members.join(labels.select(F.col("category").alias("_c"), "label"), F.col("category") == F.col("_c"), "left")
    return named.select(opaque_id("sample_", domain, F.col("signer"), F.col("category"), F.col("recording")).alias("sample_id"), opaque_id("recording_", domain, F.col("recording")).alias("recording_id"), opaque_id("participant_", domain, F.col("signer")).alias("signer_id"), "label", "split", "size_bytes")


def write_predictions(df: DataFrame, path: str) -> None:
    """Flat CSV with header: partition, model, sample, signer, quality, actual, predicted."""
    df.select("partition", "model", "sample", "signer", "quality", "actual", "predicted").write.option("header", True).mode("errorifexists").csv(path)


def with_content_address(df: DataFrame, digest: str, name: str) -> DataFrame:
    """Adds path and p, the two-hex prefix to partition by."""
    return df.withColumn("path", content_path(F.col(digest), F.col(name))).withColumn("p", F.substring(digest, 1, 2))


def reuse_or_compute(keys: DataFrame, cache: DataFrame, compute, key: str, value: str) -> DataFrame:
    """(key, value, source): cached values of known keys, computed ones of the rest; compute takes the missing keys."""
    hit = keys.join(cache.select(F.col(key).alias("_k"), F.col(value)), F.col(key) == F.col("_k")).select(key, value, F.lit("cache").alias("source"))
    rest = keys.join(cache.select(F.col(key).alias("_k")), F.col(key) == F.col("_k"), "left_anti")
    return hit.unionByName(compute(rest).select(key, value, F.lit("computed").alias("source")))


def cache_conflicts(cache: DataFrame, key: str, digest: str) -> DataFrame:
    """Keys that the cache holds with different contents."""
    return cache.groupBy(key).agg(F.count_distinct(digest).alias("contents")).where("contents > 1")


def append_runs(path: str, **tables: DataFrame) -> None:
    """Appends runs, params, metrics and artifacts to the ledger's folders."""
    for name, df in tables.items():
        df.write.mode("append").parquet(f"{path}/{name}")


def verify_runs(runs: DataFrame, artifacts: DataFrame, inventory: DataFrame) -> DataFrame:
    """(run_id, artifacts, verified): how many of a run's artifacts (run_id, name, sha256) are in the inventory (name, sha256) unchanged."""
    found = inventory.select(F.col("name").alias("_n"), F.col("sha256").alias("_h"))
    each = artifacts.join(found, (F.col("name") == F.col("_n")) & (F.col("sha256") == F.col("_h")), "left").groupBy(F.col("run_id").alias("_r")).agg(F.count("*").alias("n"), F.count("_n").alias("ok"))
    zero = F.lit(0).cast("bigint")
    return runs.join(each, F.col("run_id") == F.col("_r"), "left").select("run_id", F.coalesce("n", zero).alias("artifacts"), F.coalesce("ok", zero).alias("verified"))


def normalize_runs(df: DataFrame, key: str, settings: str, status: str) -> DataFrame:
    """(run_number, key, setting map, status, notes): settings parsed from JSON, known states, and notes on what is wrong."""
    from pyspark.sql import Window

    parsed = df.withColumn("settings", F.from_json(settings, "map<string,string>"))
    known = F.when(F.lower(status).isin("finished", "purchase"), "success").when(F.lower(status).isin("failed", "error"), "failure").otherwise("unknown")
    notes = F.array_compact(F.array(F.when(F.col("settings").isNull(), F.lit("settings_unreadable")), F.when(known == "unknown", F.lit("status_unknown"))))
    return parsed.select(F.row_number().over(Window.partitionBy(known).orderBy(key)).alias("run_number"), key, "settings", known.alias("status"), F.array_join(notes, ",").alias("notes"))


def read_partitions(spark: SparkSession, path: str, partitions: tuple[str, ...]) -> DataFrame:
    """Rows of the asked partitions of a table laid out by partition=; the others' files aren't opened."""
    return spark.read.parquet(path).where(F.col("partition").isin(*partitions))
