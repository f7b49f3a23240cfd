"""Privacy of nested records: every key and every text at any depth, by path, in JSON texts and in columns of structs, arrays and maps alike."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources.staging import written

#: Words that no key may have, keys that are forbidden without their punctuation, and keys that are allowed nevertheless.
KEY_WORDS = ("address", "caption", "comment", "comments", "contact", "description", "details", "email", "free_text", "freetext", "identity", "message", "name", "note", "notes", "phone", "signature", "telephone", "text")
COMPACT_KEYS = ("birthdate", "contactdetails", "dateofbirth", "firstname", "fullname", "governmentid", "identitydocument", "lastname", "signedby")
ALLOWED_KEYS = ("identity_inference", "identity_vault_attestation_sha256", "identity_vault_operations_ready", "identity_verification_attestation_sha256", "participant_contact_process_ready", "reason_code")

#: What a text may not be or hold.
TEXT_RULES = {
    "machine_path": r"(?i)^file:|^~[/\\]|(^|\s)[a-z]:[\\/]|^\\\\|^/",
    "raw_uuid": r"(?i)(^|[^0-9a-z])[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}($|[^0-9a-z])",
    "absolute_time": r"(^|[^0-9])[0-9]{4}-[0-9]{2}-[0-9]{2}[T ][0-9]{2}:[0-9]{2}",
}


def forbidden_key(key: Column) -> Column:
    """Whether a key has a forbidden word between its punctuation, or is a forbidden one without it, case aside."""
    low = F.lower(key)
    words = F.split(low, "[^a-z0-9]+")
    return ~key.isin(*ALLOWED_KEYS) & (F.arrays_overlap(words, F.array(*map(F.lit, KEY_WORDS))) | F.regexp_replace(low, "[^a-z0-9]", "").isin(*COMPACT_KEYS))


def walked(df: DataFrame, key: str, record: Column, most_depth: int = 64) -> DataFrame:
    """(key, path, name, text): a row for each member of each object and array of a JSON text, at any depth. name is NULL for elements, text for what isn't one.

    Each round opens one level of all records and is written; records without further levels are out of it. Invalid JSON gives one row
    with the path $ and the whole as text; deeper records than most_depth raise.
    """
    parsed = F.try_parse_json(record)
    top = df.select(F.col(key).alias("_k"), record.alias("_raw"), parsed.alias("_v")).where("_raw IS NOT NULL")
    broken = top.where("_v IS NULL").select(F.col("_k").alias(key), F.lit("$").alias("path"), F.lit(None).cast("string").alias("name"), F.col("_raw").alias("text"))
    alone = top.where("_v IS NOT NULL").select("_k", F.lit("$").alias("path"), F.to_json("_v").alias("_j"))
    level = written(alone, "records")
    leaf = F.get_json_object(F.concat(F.lit('{"x":'), F.col("_j"), F.lit("}")), "$.x")
    found = [broken, level.where("_j LIKE '\"%'").select(F.col("_k").alias(key), "path", F.lit(None).cast("string").alias("name"), leaf.alias("text"))]
    for _ in range(most_depth):
        nested = level.where("_j LIKE '{%' OR _j LIKE '[%'").withColumn("_v", F.parse_json("_j"))
        each = nested.select("_k", "path", "_v").lateralJoin(df.sparkSession.tvf.variant_explode(F.col("_v").outer()))
        at = F.when(F.col("key").isNotNull(), F.concat("path", F.lit("."), "key")).otherwise(F.concat("path", F.lit("["), F.col("pos").cast("string"), F.lit("]")))
        level = written(each.select("_k", at.alias("path"), F.col("key").alias("_name"), F.to_json("value").alias("_j")), "records")
        if level.isEmpty():
            break
        found.append(level.select(F.col("_k").alias(key), "path", F.col("_name").alias("name"), F.when(F.col("_j").startswith('"'), leaf).alias("text")))
    else:
        raise RuntimeError(f"records are deeper than {most_depth}")
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out


def nested_violations(df: DataFrame, key: str, record: Column | None = None, columns: tuple[str, ...] = ()) -> DataFrame:
    """(rule_id, key, path): forbidden keys and texts that are machine paths, raw UUIDs or absolute times, a row for each path and rule.

    record: a JSON text; or columns of any nesting, which are read as one record of those names. Texts in JSON texts inside a record aren't opened.
    """
    whole = record if record is not None else F.to_json(F.struct(*columns))
    rows = walked(df, key, whole)
    kinds = [F.when(F.col("name").isNotNull() & forbidden_key(F.col("name")), "forbidden_key"), *(F.when(F.col("text").rlike(p), n) for n, p in TEXT_RULES.items())]
    return rows.select(F.explode(F.array_compact(F.array(*kinds))).alias("rule_id"), key, "path")


def redacted(df: DataFrame, columns: tuple[str, ...], instead: str = "<redacted>") -> DataFrame:
    """The columns without forbidden fields and map entries at any depth, and with `instead` for texts that break a rule; other columns stay. Nulls stay nulls.

    The walk over types happens once, on the schema; data is touched by column functions only.
    """

    def clean(value: Column, kind: T.DataType) -> Column:
        if isinstance(kind, T.StringType):
            bad = F.lit(False)
            for p in TEXT_RULES.values():
                bad = bad | value.rlike(p)
            return F.when(bad, F.lit(instead)).otherwise(value)
        if isinstance(kind, T.ArrayType):
            return F.transform(value, lambda x: clean(x, kind.elementType))
        if isinstance(kind, T.MapType):
            kept = F.map_filter(value, lambda k, v: ~forbidden_key(k)) if isinstance(kind.keyType, T.StringType) else value
            return F.transform_values(kept, lambda k, v: clean(v, kind.valueType))
        if isinstance(kind, T.StructType):
            left = [f for f in kind if not _forbidden(f.name)]
            fields = [clean(value.getField(f.name), f.dataType).alias(f.name) for f in left]
            return F.when(value.isNotNull(), F.struct(*fields)) if fields else F.lit(None).cast("struct<>")
        return value

    kept = [c for c in df.columns if c not in columns or not _forbidden(c)]
    return df.select(*(clean(F.col(f"`{c}`"), df.schema[c].dataType).alias(c) if c in columns else F.col(f"`{c}`") for c in kept))


def _forbidden(name: str) -> bool:
    """As forbidden_key, of a field of the schema."""
    low = name.lower()
    parts = "".join(c if c.isascii() and c.isalnum() else " " for c in low)
    return name not in ALLOWED_KEYS and (not set(parts.split()).isdisjoint(KEY_WORDS) or parts.replace(" ", "") in COMPACT_KEYS)
