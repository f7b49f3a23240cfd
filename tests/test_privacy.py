"""Nested privacy scans by path, and typed redaction."""

from pyspark.sql import functions as F

from strandline.operators import privacy as V

RECORDS = [
    (1, '{"a": {"Free-Text": 1, "ok": [{"first_name": "x"}, "~/x", ["file:///x"]]}}'), (2, '"C:\\\\x"'), (3, "[1, null, true, {}]"), (4, None), (5, "{broken"), (6, '{"reason_code": "r", "identityDocument": {"n": "/etc"}, "when": "2024-01-02 03:04"}'),
    (7, '{"context": "a/b", "texture": "https://x/y", "id": "00000000-0000-0000-0000-000000000000"}'), (8, "{}"), (8, '{"note": null}'),
]


def test_every_path_is_found(spark):
    df = spark.createDataFrame(RECORDS, "path int, record string")
    got = sorted(tuple(r) for r in V.nested_violations(df.withColumnRenamed("path", "k"), "k", F.col("record")).collect())
    assert got == sorted([
        ("forbidden_key", 1, "$.a.Free-Text"), ("forbidden_key", 1, "$.a.ok[0].first_name"), ("machine_path", 1, "$.a.ok[1]"), ("machine_path", 1, "$.a.ok[2][0]"), ("machine_path", 2, "$"),
        ("forbidden_key", 6, "$.identityDocument"), ("machine_path", 6, "$.identityDocument.n"), ("absolute_time", 6, "$.when"), ("raw_uuid", 7, "$.id"), ("forbidden_key", 8, "$.note"),
    ])


def test_typed_columns_and_redaction(spark):
    df = spark.createDataFrame([(1, {"email": "x", "k": "/root"}, ("v", "n", [("file:x",)]), "keep /root"), (2, None, None, None)], "k int, props map<string,string>, s struct<v:string,full_name:string,l:array<struct<p:string>>>, other string")
    found = sorted(tuple(r) for r in V.nested_violations(df, "k", columns=("props", "s")).collect())
    assert found == [("forbidden_key", 1, "$.props.email"), ("forbidden_key", 1, "$.s.full_name"), ("machine_path", 1, "$.props.k"), ("machine_path", 1, "$.s.l[0].p")]
    clean = V.redacted(df, ("props", "s"))
    first, second = clean.orderBy("k").collect()
    assert first["props"] == {"k": "<redacted>"} and first["s"].asDict(True) == {"v": "v", "l": [{"p": "<redacted>"}]} and first["other"] == "keep /root"
    assert second["props"] is None and second["s"] is None
    assert V.nested_violations(clean, "k", columns=("props", "s")).count() == 0


def test_nothing_to_scan(spark):
    assert V.nested_violations(spark.createDataFrame([], "k int, r string"), "k", F.col("r")).count() == 0
