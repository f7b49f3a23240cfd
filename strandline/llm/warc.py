"""A content-addressed archive of WARC records.

A payload's bytes are stored once, under their SHA-256; each record's header block is kept exactly, in a table of its
own, with that digest. The original records come back through a join of the two, checked against the digest.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import stage

CRLF = "\r\n"


@dataclass(frozen=True)
class Archive:
    """Where the two tables of an archive are."""

    path: str

    @property
    def headers(self) -> str:
        return f"{self.path}/headers"

    @property
    def payloads(self) -> str:
        return f"{self.path}/payloads"


def _uuid(key: Column) -> Column:
    """A record id of UUID form from a digest of the key: equal on every run."""
    h = F.sha2(F.concat(F.lit("record:"), key.cast("string")).cast("binary"), 256)
    return F.concat(F.lit("urn:uuid:"), F.concat_ws("-", *(F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12)))))


def _lines(*fields: tuple[str, Column] | Column) -> Column:
    return F.concat(*(F.concat(F.lit(f[0] + ": "), f[1], F.lit(CRLF)) if isinstance(f, tuple) else f for f in fields))


def write_archive(pages: DataFrame, path: str, payload: str = "html", id_col: str = "page_id", url: str = "url", least: int = 100, date: str = "2020-01-01T00:00:00Z") -> Archive:
    """Writes a WARC record per row: response, or revisit of the record with the smallest id among equal payloads of `least` bytes or more.

    A null payload is empty and a null url is `about:blank`; line ends in a url are percent-encoded. A row with a null id gets a record whose id text is
    empty; among equal payloads such rows come last. Rows that repeat an id with the same payload are
    each a response if their id is the smallest. Payload bytes are shuffled once, by digest; records are marked on digests alone.
    """
    body = F.coalesce(F.col(payload).cast("string"), F.lit("")).cast("binary")
    keyed = pages.select(F.col(id_col).alias("_id"), F.replace(F.replace(F.coalesce(F.col(url), F.lit("about:blank")), F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A")).alias("_url"), body.alias("_body"))
    keyed = keyed.withColumn("payload_digest", F.sha2("_body", 256)).withColumn("payload_bytes", F.octet_length("_body").cast("bigint"))
    small = keyed.select("_id", "_url", "payload_digest", "payload_bytes")
    first = small.groupBy("payload_digest").agg(F.min("_id").alias("_first"))
    marked = small.join(first, "payload_digest")
    revisit = (F.col("payload_bytes") >= least) & F.col("_first").isNotNull() & ~F.col("_id").eqNullSafe(F.col("_first"))
    marked = marked.withColumn("record_type", F.when(revisit, "revisit").otherwise("response")).withColumn("refers_to", F.when(revisit, F.col("_first")))
    id_text = F.coalesce(F.col("_id").cast("string"), F.lit(""))
    http = _lines(F.lit("HTTP/1.1 200 OK" + CRLF), ("Content-Type", F.lit("text/html; charset=utf-8")), ("Content-Length", F.col("payload_bytes").cast("string")), F.lit(CRLF))
    sent = F.when(F.col("record_type") == "response", F.col("payload_bytes")).otherwise(F.lit(0))
    # a revisit carries its HTTP header only and names the record that has the body
    warc = _lines(
        F.lit("WARC/1.1" + CRLF),
        ("WARC-Type", F.col("record_type")),
        ("WARC-Record-ID", F.concat(F.lit("<"), _uuid(id_text), F.lit(">"))),
        F.when(F.col("_id").isNull(), F.lit("")).otherwise(_lines(("X-Record-Key", id_text))),
        ("WARC-Date", F.lit(date)),
        ("WARC-Target-URI", F.col("_url")),
        ("WARC-Payload-Digest", F.concat(F.lit("sha256:"), F.col("payload_digest"))),
        F.when(F.col("record_type") == "revisit", _lines(("WARC-Refers-To", F.concat(F.lit("<"), _uuid(F.col("refers_to").cast("string")), F.lit(">"))), ("WARC-Profile", F.lit("http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")))).otherwise(F.lit("")),
        ("Content-Type", F.lit("application/http; msgtype=response")),
        ("Content-Length", (F.octet_length(http) + sent).cast("string")),
        F.lit(CRLF),
    )
    headers = marked.select(F.col("_id").alias("record_key"), "record_type", "refers_to", "payload_digest", "payload_bytes", F.concat(warc, http).cast("binary").alias("header"))
    archive = Archive(path)
    headers.write.option("compression", "zstd").parquet(archive.headers)
    # equal payloads are combined before the one shuffle, so a payload that a third of all rows has moves once per task
    once = keyed.groupBy("payload_digest").agg(F.first("_body").alias("payload"))
    once.write.option("compression", "zstd").parquet(archive.payloads)
    return archive


def read_archive(spark: SparkSession, archive: Archive) -> DataFrame:
    """The original records: record_key, record_type, refers_to, payload_digest, payload_bytes, record (the exact bytes) and payload.

    A payload that is missing, or whose length or SHA-256 isn't the header's, fails the read.
    """
    headers = spark.read.parquet(archive.headers)
    stored = spark.read.parquet(archive.payloads)
    stored = stored.select(F.col("payload_digest").alias("_digest"), F.when(F.sha2("payload", 256) == F.col("payload_digest"), F.col("payload")).otherwise(F.raise_error(F.lit("a stored payload doesn't have its digest")).cast("binary")).alias("payload"))
    joined = headers.join(stored, F.col("payload_digest") == F.col("_digest"), "left")
    whole = F.octet_length("payload") == F.col("payload_bytes")
    payload = F.when(whole, F.col("payload")).otherwise(F.raise_error(F.lit("a payload is missing or cut")).cast("binary"))
    body = F.when(F.col("record_type") == "response", payload).otherwise(F.lit(b""))
    return joined.select("record_key", "record_type", "refers_to", "payload_digest", "payload_bytes", F.concat("header", body, F.lit((CRLF + CRLF).encode())).alias("record"), payload.alias("payload"))


def record_fields(records: DataFrame) -> DataFrame:
    """record_key, payload_bytes, payload_digest, record_type and refers_to, all parsed from the bytes of `record`.

    A revisit's payload is that of the record it names. A record whose lengths or digest don't agree with its bytes, or a
    revisit that names no record with its digest, fails the read.
    """
    blank = CRLF + CRLF
    head_of = lambda c: F.substring_index(F.col(c).cast("string"), blank, 1)
    after = lambda c, head: F.expr(f"substring({c}, octet_length({head}) + {len(blank) + 1})")
    field = lambda head, name: F.regexp_extract(head, f"(?m)^{name}: ([^\r\n]*)", 1)
    fail = lambda text: F.raise_error(F.lit(text))
    split = records.select("record", head_of("record").alias("warc")).withColumn("rest", after("record", "warc"))
    split = split.withColumn("block", F.expr(f"substring(rest, 1, octet_length(rest) - {len(blank)})")).withColumn("http", head_of("block")).withColumn("body", after("block", "http"))
    response, sent = field("warc", "WARC-Type") == "response", field("http", "Content-Length").cast("bigint")
    told = F.substring(field("warc", "WARC-Payload-Digest"), len("sha256:") + 1, 64)
    whole = (field("warc", "Content-Length").cast("bigint") == F.octet_length("block")) & (F.octet_length("body") == F.when(response, sent).otherwise(0))
    digest = F.when(~F.coalesce(whole, F.lit(False)), fail("a record's length isn't its header's").cast("string")).when(response & (F.sha2("body", 256) != told), fail("a record's payload doesn't have its header's digest").cast("string")).otherwise(told)
    key = F.when(F.col("warc").contains(CRLF + "X-Record-Key: "), field("warc", "X-Record-Key")).cast(records.schema["record_key"].dataType)
    parsed = stage(split.select(key.alias("record_key"), sent.alias("payload_bytes"), digest.alias("payload_digest"), field("warc", "WARC-Type").alias("record_type"), field("warc", "WARC-Record-ID").alias("_rid"), field("warc", "WARC-Refers-To").alias("_ref")), "record-fields")
    named = parsed.where("record_type = 'response'").groupBy(F.col("_rid").alias("_to"), F.col("payload_digest").alias("_digest"), F.col("payload_bytes").alias("_bytes")).agg(F.min("record_key").alias("_key"))
    joined = parsed.join(named, (F.col("record_type") == "revisit") & (F.col("_ref") == F.col("_to")) & (F.col("payload_digest") == F.col("_digest")) & (F.col("payload_bytes") == F.col("_bytes")), "left")
    kind = records.schema["record_key"].dataType
    refers_to = F.when(F.col("record_type") == "response", F.lit(None).cast(kind)).when(F.col("_key").isNull(), fail("a revisit names no record with its digest").cast(kind)).otherwise(F.col("_key"))
    return joined.select("record_key", "payload_bytes", "payload_digest", "record_type", refers_to.alias("refers_to"))
