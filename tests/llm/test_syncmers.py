"""Closed syncmers against a plain computation, at block cuts, on odd tables."""

import hashlib
import zlib

import pytest
from pyspark.sql import functions as F

from strandline.llm import syncmers as S

K, W, INNER = S.K, S.WINDOW, S.S


def plain_links(text):
    data = (text or "").encode()
    inner = [zlib.crc32(data[i : i + INNER]) for i in range(len(data) - INNER + 1)]
    found = [i for i in range(len(data) - K + 1) if min(inner[i], inner[i + W - 1]) == min(inner[i : i + W])]
    if not found:
        return [(zlib.crc32(data) >> 8) << 8]
    return [((zlib.crc32(data[i : i + K]) >> 8) << 8) + (b - i if b else 0) for i, b in zip(found, [*found[1:], 0])]


def likeness(a, b):
    return 2 * len(set(a) & set(b)) / (len(set(a)) + len(set(b)))


def plain_rows(rows):
    """rows of (doc_id, text) in any order; ids without nulls come first, larger ones before smaller ones."""
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, (r[1] or "").encode()), reverse=True)
    found = []
    for k, (doc_id, text) in enumerate(order):
        text, after = text or "", order[(k + 1) % len(order)][1] or ""
        third = len(text) // 3
        edited = text[: len(text) - third] + after[:third]
        own, new, other = plain_links(text), plain_links(edited), plain_links(after)
        shown = lambda x: "".join(f"{v:08X}" for v in x)
        found.append((doc_id, len(text), hashlib.sha256(edited.encode()).hexdigest(), shown(own), shown(new), likeness(own, new), likeness(own, other)))
    return sorted(found, key=repr)


LONG = "".join(hashlib.sha256(bytes([k])).hexdigest() for k in range(11))[:700]
ODD = [(5, None), (4, ""), (9, LONG), (7, LONG[:300] + "é日😀" + LONG[50:400]), (7, "x" * 500), (1, "short"), (2, LONG), (None, "no id " * 30), (3, "\n \n"), (-8, "ä" * 23), (10**15, "a longer text without any repeats 0123456789 at all")]


@pytest.mark.parametrize("rows_per_range", [1, 2, 64])
def test_fingerprints_equal_plain_ones(spark, rows_per_range):
    docs = spark.createDataFrame([(*r, k, "z") for k, r in enumerate(ODD)], "doc_id bigint, text string, n_chars int, _range string").repartition(3)
    got = sorted((tuple(r) for r in S.fingerprint_documents(docs, rows_per_range).collect()), key=repr)
    assert got == plain_rows(ODD)


def test_blocks_change_nothing(spark, monkeypatch):
    docs = spark.createDataFrame([(k, t) for k, t in enumerate([LONG * 3, LONG[:24], LONG[:23], "é" * 60 + LONG])], "doc_id bigint, text string")
    want = [r[0] for r in docs.select(S.anchors(F.col("text"))).collect()]
    for block in (1, 7, 100):
        monkeypatch.setattr(S, "BLOCK", block)
        assert [r[0] for r in docs.select(S.anchors(F.col("text"))).collect()] == want


def test_every_window_of_kmers_holds_an_anchor(spark):
    docs = spark.createDataFrame([(LONG * 2,)], "text string")
    at = [x >> 24 for x in docs.select(S.anchors(F.col("text"))).first()[0]]
    assert max(b - a for a, b in zip([-1, *at], [*at, len(LONG) * 2 - K + 1])) <= W


def test_one_row_and_no_rows(spark):
    docs = spark.createDataFrame([(3, LONG)], "doc_id bigint, text string")
    assert [tuple(r) for r in S.fingerprint_documents(docs).collect()] == plain_rows([(3, LONG)])
    assert S.fingerprint_documents(docs.limit(0)).collect() == []
    nulls = spark.createDataFrame([(None, "b" * 40), (None, "a" * 40)], "doc_id bigint, text string")
    assert sorted((tuple(r) for r in S.fingerprint_documents(nulls).collect()), key=repr) == plain_rows([(None, "b" * 40), (None, "a" * 40)])


def test_moved_passages_are_still_alike(spark):
    docs = spark.createDataFrame([(LONG, "A different beginning. " + LONG)], "a string, b string")
    near = docs.select(S.likeness(S.links(S.anchors(F.col("a")), F.col("a")), S.links(S.anchors(F.col("b")), F.col("b")))).first()[0]
    assert near > 0.9


def test_no_python_and_one_shuffle_of_texts(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    plan = S.fingerprint_documents(docs)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "Python" not in plan and "Arrow" not in plan
