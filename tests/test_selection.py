"""Aliases beyond their width, and sequences of a fixed length taken from whole ones."""

from pyspark.sql import functions as F

from strandline.functions import scalars as S
from strandline.operators import features as X
from strandline.operators import selection as P
from strandline.plans import feature_queries
from strandline.plans.bindings import frames

SF = "/root/testdata/sf0.001"


def test_aliases_stay_one_to_one_beyond_their_width(spark):
    ids = spark.range(1, 1206, numPartitions=7).select((F.col("id") * 3).alias("k"))
    df = P.alias(ids.unionByName(ids).unionByName(spark.sql("SELECT CAST(NULL AS BIGINT) AS k")), "k", "s_", 2)
    got = {r["k"]: r["alias"] for r in df.collect()}
    assert got == {3 * k: f"s_{k:02d}" for k in range(1, 1206)}
    assert P.alias(ids.limit(0), "k", "s_").count() == 0


def test_fixed_length_keeps_both_ends(spark):
    df = spark.range(4).select(F.element_at(F.array(F.lit(0), F.lit(1), F.lit(5), F.lit(131)), (F.col("id") + 1).cast("int")).alias("n"))
    values = F.when(F.col("n") > 0, F.sequence(F.lit(1).cast("bigint"), F.col("n").cast("bigint"))).otherwise(F.array().cast("array<bigint>"))
    got = {r["n"]: r["v"] for r in df.select("n", S.fixed_length(values, 5, F.lit(0).cast("bigint")).alias("v")).collect()}
    assert got == {0: [0] * 5, 1: [1, 0, 0, 0, 0], 5: [1, 2, 3, 4, 5], 131: [1, 34, 66, 99, 131]}


def test_training_features_reach_the_last_frame(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(X, "training_violations", lambda features, split: seen.append(features) or features)
    feature_queries.m12_training_violations(spark, SF)
    last = {r["rec"]: (r["n"], r["i"]) for r in frames(spark, SF).groupBy("rec").agg(F.count("*").alias("n"), F.max("i").alias("i")).collect()}
    got = {r["rec"]: r["values_q"][0] for r in seen[0].collect()}
    assert any(n > 64 for n, _ in last.values()) and set(got) == set(last)
    assert all(len(v) == 64 and v[min(last[k][0], 64) - 1] == last[k][1] for k, v in got.items())
