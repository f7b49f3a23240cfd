"""Statistics, models, mixing and search against plain computations of the same thing, and the pipeline's stages on odd tables."""

import importlib
import math
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from strandline.llm import jaccard_join as J
from strandline.llm import language_id as I
from strandline.llm import mixing as X
from strandline.llm import quality as Q
from strandline.llm import queries, vector_search

SF = "/root/testdata/sf0.001"
KINDS = {"lower": b"abcdefghijklmnopqrstuvwxyz", "upper": b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", "digit": b"0123456789", "stop": b".,;:?'\"", "mark": b"*#$%&@^~=+", "shout": b"!", "bar": b"|", "bracket": b"()[]{}<>/\\_", "line": b"\n", "blank": b" \t\r\v\f"}


def plain_statistics(text):
    data = text.encode()
    kind = lambda b: next((k for k, v in KINDS.items() if b in v), "beyond" if b > 127 else "other")
    words, lines = data.split(), data.split(b"\n")
    lines = lines[:-1] if not lines[-1] else lines
    n = max(len(words), 1)
    share = lambda flag: sum(map(flag, words)) / n
    distinct = lambda x: len(set(x)) / len(x) if x else 1.0
    by_kind = Counter(map(kind, data))
    return [
        math.log1p(len(data)), math.log1p(len(words)), sum(map(len, words)) / n, math.log1p(max(map(len, words), default=0)), *(by_kind[k] / max(len(data), 1) for k in Q._KINDS),
        distinct(words), distinct(lines), math.log1p(len(words) / max(len(lines), 1)), share(lambda w: kind(w[0]) == "upper"), share(lambda w: kind(w[-1]) == "mark"), share(lambda w: kind(w[-1]) == "shout"), share(lambda w: len(w) <= 2), math.log1p(len(lines)),
    ]


def test_statistics_equal_plain_ones(spark):
    texts = ["", "a\n", "b c\n\nb c", "\n", "Héllo WORLD!! *x* 12|34 (a_b)", "x" * 3000, "", "one\ntwo\none\n", *(r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").select("text").collect())]
    got = Q.statistics(pa.array([t.encode() for t in texts], pa.large_binary()))
    assert got.shape == (len(texts), len(Q.FEATURES))
    np.testing.assert_allclose(got, [plain_statistics(t) for t in texts], atol=1e-9)


def test_scores_do_not_depend_on_partitions_or_other_columns(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").withColumn("score", F.lit("clash")).withColumn("predicted", F.lit("clash"))
    forest = Q.fit_quality(docs, spark.read.parquet(f"{SF}/labels.parquet"))
    rows = docs.unionByName(docs.where("doc_id % 3 = 0"))
    a, b = (sorted(map(tuple, Q.score_quality(x, forest).collect())) for x in (rows.repartition(1), rows.repartition(7, "text")))
    assert a == b and len(a) == rows.count()


def plain_kneser_ney(words, order):
    """Log-probabilities of a word by dictionaries: {gram: count} and all that follows from it."""
    counts = [Counter() for _ in range(order + 1)]
    for w, times in Counter(words).items():
        text = f"^{w}$"
        for p in range(1, len(text)):
            for n in range(1, order + 1):
                if p >= n - 1:
                    counts[n][text[p - n + 1 : p + 1]] += times
    floor = 1 / (len(counts[1]) + 1)
    used = [None] * (order + 1)
    for n in range(1, order + 1):
        wider = Counter(g[1:] for g in counts[n + 1]) if n < order else {}
        used[n] = {g: wider.get(g) or c for g, c in counts[n].items()}
    discount = [None] * (order + 1)
    total, kinds = defaultdict(int), defaultdict(int)
    for n in range(1, order + 1):
        ones, twos = (sum(c == k for c in used[n].values()) for k in (1, 2))
        discount[n] = ones / (ones + 2 * twos) if ones and twos else 0.5
        for g, c in used[n].items():
            total[n, g[:-1]] += c
            kinds[n, g[:-1]] += 1

    def prob(gram):
        n = len(gram)
        if not n:
            return floor
        lower = prob(gram[1:])
        at = (n, gram[:-1])
        if at not in total:
            return lower
        back = discount[n] * kinds[at] / total[at] * lower
        return (used[n][gram] - discount[n]) / total[at] + back if gram in used[n] else back

    def log_prob(word):
        text = f"^{word}$"
        return [math.log(prob(text[max(0, p - order + 1) : p + 1])) for p in range(1, len(text))]

    return log_prob


@pytest.mark.parametrize("order", [1, 2, 3, 4])
def test_kneser_ney_equals_dictionaries(spark, order):
    texts = ["abab ab a abba cab", "ba bab abcab ab ab", "caba b abba baobab"]
    docs = spark.createDataFrame([(k, t, "x") for k, t in enumerate(texts)], "doc_id bigint, text string, lang string")
    model = I.fit_language_models(docs, order=order).models[0]
    plain = plain_kneser_ney(" ".join(texts).split(), order)
    for word in ("ab", "abba", "baobab", "c", "cc", "zab", "abz", "qqq", "a"):
        hashes, _ = I.grams([word], order)
        np.testing.assert_allclose(model.score(hashes, I.context_hashes(hashes, [word])), plain(word), atol=1e-9)


def test_identify_edges(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    models = I.fit_language_models(I.training_rows(docs))
    clash = docs.withColumn("lang_pred", F.lit(1)).withColumn("rejected", F.lit("x"))
    twice = I.identify(clash.unionByName(clash), models).collect()
    assert len(twice) == 2 * docs.count() and len(set(map(tuple, twice))) == len(set(map(tuple, I.identify(docs, models).collect())))
    assert I.identify(docs.limit(0), models).count() == 0
    # two languages with the same text: ties go to the first in name
    same = spark.createDataFrame([(1, "abc abd", "y"), (2, "abc abd", "x")], "doc_id bigint, text string, lang string")
    assert {r["lang_pred"] for r in I.identify(same, I.fit_language_models(same)).collect()} == {"x"}


def test_mixing_solves_the_dual(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "source")
    sizes = docs.select("source", X.word_count(F.col("text")).alias("size")).toPandas()
    sources = X.source_targets(spark.createDataFrame(sizes))
    table = sizes.groupby(["source", "size"]).size().rename("n").reset_index()
    mean = sizes.groupby("source")["size"].mean()
    table["z"] = table["size"] / table["source"].map(mean).clip(lower=1)
    state = X.balance(spark.createDataFrame(table), sources)
    taken = X.mix(docs).groupBy("source").agg(F.sum("taken").alias("taken")).toPandas().set_index("source")["taken"]
    for row in state.itertuples(index=False):
        own = table[table["source"] == row.source]
        words = lambda tilt: (own["n"] * own["size"] * 2 / (1 + np.exp(-tilt * own["z"]))).sum()  # noqa: E731, B023
        if row.target >= 2 * row.source_size * (1 - 1e-12):
            assert row.tilt == np.inf
        else:
            low, high = -60.0, 60.0
            for _ in range(200):  # a plain bisection of the monotone sum
                mid = (low + high) / 2
                low, high = (mid, high) if words(mid) < row.target else (low, mid)
            assert abs(words(row.tilt) - row.target) <= 1e-6 * row.target + 1e-5 and abs(row.tilt - low) < 1e-4
        # whole copies of a source of ten documents miss by half of one at most
        assert abs(taken[row.source] - row.target) <= own["size"].max() / 2 + 1


def test_vector_search_recall_at_scale(spark):
    sf = "/root/testdata/sf0.1"
    found = queries.op5_vector_search(spark, sf).toPandas()
    table = spark.read.parquet(f"{sf}/embeddings.parquet").toPandas().sort_values("vec_id")
    x, ids = np.stack(table["embedding"].to_numpy()).astype(float), table["vec_id"].to_numpy()
    asked = np.flatnonzero(ids % 20 == 0)
    score = x[asked] @ x.T
    score[np.arange(len(asked)), asked] = -np.inf
    best = {int(ids[q]): set(ids[np.argsort(-s, kind="stable")[:20]]) for q, s in zip(asked, score)}
    got = found.groupby("query_id")["vec_id"].apply(set)
    assert len(got) == len(asked) and (found.groupby("query_id").size() == 20).all()
    assert sum(len(best[q] & got[q]) for q in best) >= 0.9 * 20 * len(asked)


def test_vector_search_goes_on_until_it_has_k(spark):
    rng = np.random.default_rng(5)
    rows = [(k, rng.normal(size=8).tolist()) for k in range(60)]
    table = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")
    index = vector_search.fit_index(vector_search.usable(table, "vec_id", "embedding"), 20)
    index.probes = 1  # far too few lists
    got = vector_search.search(table, "vec_id % 20 = 0", 20, index).groupBy("query_id").count().collect()
    assert {(r["query_id"], r["count"]) for r in got} == {(0, 20), (20, 20), (40, 20)}


def test_jaccard_blocks_stay_near_the_true_groups(spark, monkeypatch):
    kept = {}

    def keep(df, name):
        kept[name] = stage(df, name)
        return kept[name]

    stage = J.stage
    monkeypatch.setattr(J, "stage", keep)
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    found = J.jaccard_components(docs, J.Similarity(5, 80, 100))
    largest = found.groupBy("component_id").count().agg(F.max("count")).first()[0]
    for name in ("first-blocks", "second-blocks"):
        sizes = kept[name].groupBy("component").agg(F.count_distinct("rep").alias("n")).agg(F.max("n")).first()[0] or 0
        assert sizes <= max(16, 2 * largest)


def test_jaccard_of_very_long_and_repeated_texts(spark):
    words = [f"w{k % 7919}x{k % 13}" for k in range(60_000)]
    rows = [(1, " ".join(words)), (2, " ".join([*words[:-9], "other"])), (3, " ".join(words[:30_000])), (4, "a b c d e f"), (4, "a b c d e f"), (4, " ".join(words)), (5, "a b c d e f")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").withColumn("component_id", F.lit("clash"))
    got = {(r["doc_id"], r["component_id"]) for r in J.jaccard_components(docs, J.Similarity(5, 80, 100)).collect()}
    assert got == {(1, 1), (2, 1), (3, 3), (4, 1), (5, 1)}  # 4 has both texts, so it links their groups


def test_pipeline_stages_on_odd_and_empty_tables(spark):
    pipeline = importlib.import_module("corpus_pipeline")
    schema = spark.read.parquet(f"{SF}/documents.parquet").schema
    text = "some words that are here to be read by all of the stages " * 3
    rows = [(None, None, None, None, None), (1, "", "en", "a", 0), (2, text, None, None, None), (2, text, None, None, None), (None, text, "en", "a", len(text)), (3, "x " * 30_000, "en", "a", 60_000), (4, "12 34", "en", "b", 5), (5, "short\n" * 5, "en", "b", 30)]
    odd = spark.createDataFrame(rows, schema)
    for docs in (odd, odd.limit(0)):
        for name, step in pipeline.STAGES:
            out = step(spark, docs, SF)
            assert name == "packing" or out.columns == docs.columns
            assert out.count() <= 2 * len(rows) + 30
            if docs is not odd:
                assert out.count() == 0
