"""Language ID, quality, token counts, packing: edge cases, exact round trips, held-out accuracy."""

import binascii
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from strandline.llm import language_id as I
from strandline.llm import packing as P
from strandline.llm import quality as Q
from strandline.llm import queries
from strandline.llm import token_counts as C

SF = "/root/testdata/sf0.001"
VOCABULARY = public_tokenizers.path("word_bpe_49k.json")
ODD = [None, "", "   \n\t", "Hello world's <|endoftext|>x aaaaaaa", "İstanbul ΣΑΣ ΟΔΥΣΣΕΥΣ", "日本語 ½ ² 12345", "é à\x1c b\x85c\xa0d", "<|STARTOFTEXT|><|endoftext|>", "it's 'sun''t", "😀😀 👨‍👩‍👧", "x" * 5000, "a b " * 9000, "same", "same"]


@pytest.fixture(scope="module")
def odd(spark):
    """Ids with repeats and a null, extra columns whose names clash with the operators' own."""
    rows = [(None if k == 3 else min(k, 12), t, "x" if k % 2 else None, k) for k, t in enumerate(ODD)]
    return spark.createDataFrame(rows, "doc_id bigint, text string, lang string, n_tokens bigint")


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(VOCABULARY)


def test_token_counts_are_the_library_s(odd, library, spark):
    got = [r["n_tokens"] for r in C.count_tokens(odd.repartition(1), VOCABULARY).collect()]
    want = [len(library.encode(r["text"] or "", add_special_tokens=False).ids) for r in odd.repartition(1).collect()]
    assert got == want
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    mine = {r["doc_id"]: r["n_tokens"] for r in C.count_tokens(docs, VOCABULARY).collect()}
    assert mine == {r["doc_id"]: len(library.encode(r["text"], add_special_tokens=False).ids) for r in docs.collect()}


def test_token_counts_of_nothing(odd):
    assert C.count_tokens(odd.limit(0), VOCABULARY).count() == 0


def test_overlapping_merges_take_turns_from_the_left():
    table = C.MergeTable(VOCABULARY)
    library = Tokenizer.from_file(VOCABULARY)
    words = ["a" * n for n in range(1, 40)] + ["ab" * n for n in range(1, 20)] + ["-" * n for n in range(1, 30)]
    assert table.count([w.encode() for w in words]).tolist() == [len(library.encode(w, add_special_tokens=False).ids) for w in words]


def pieces_agree(pieces, texts, library):
    """Each id of each text lies in one piece, offsets leave no gap, sequences hold at most 4096 ids."""
    want = {}
    for key, text in texts:
        ids = np.array([*library.encode(text or "", add_special_tokens=False).ids, 2], "<u4")
        for s in range(0, len(ids), 4096):
            want.setdefault((key, s, min(4096, len(ids) - s), zlib.crc32(ids[s : s + 4096].tobytes()), len(ids)), []).append(1)
    got = {}
    for r in pieces:
        got.setdefault((r["doc_id"], r["start"], r["length"], r["ids_crc32"], r["doc_tokens"]), []).append(1)
    assert got == want
    ends: dict = {}
    for r in sorted(pieces, key=lambda r: (r["sequence_id"], r["offset"])):
        assert r["offset"] == ends.get(r["sequence_id"], 0)
        ends[r["sequence_id"]] = r["offset"] + r["length"]
    assert max(ends.values()) <= 4096
    return ends


def test_packing_round_trip(odd, library, spark):
    rows = [(r["doc_id"], r["text"]) for r in odd.collect()]
    pieces_agree(P.pack_documents(odd, VOCABULARY).collect(), rows, library)
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    ends = pieces_agree(P.pack_documents(docs, VOCABULARY).collect(), [(r["doc_id"], r["text"]) for r in docs.collect()], library)
    padding = sum(4096 - e for e in ends.values())
    assert padding < 0.02 * sum(ends.values()) + 4096
    assert P.pack_documents(odd.limit(0), VOCABULARY).count() == 0


def test_packing_balances_cost():
    bins, offsets = P.balanced(np.array([3000, 2000, 1500, 900, 700, 92]), 4096, 1.0, 1 / 4096)
    # costs after each piece, by hand: 5197 in sequence 0; 2977, then 5026 in 1; 6295 in 0; 700 fits neither; 92 goes to the cheapest
    assert bins.tolist() == [0, 1, 1, 0, 2, 2] and offsets.tolist() == [0, 0, 2000, 3000, 0, 700]


def test_language_of_held_out_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    found = queries.op7_language_id(spark, SF).join(docs.select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert sum(r["lang_pred"] == r["lang"] for r in found) >= 0.97 * len(found)
    assert not any(r["rejected"] for r in found)


def test_language_edge_cases(odd, spark):
    models = I.fit_language_models(I.training_rows(spark.read.parquet(f"{SF}/documents.parquet")))
    got = {(r["doc_id"], r["lang_pred"]): r for r in I.identify(odd, models).collect()}
    for key in (0, 1, 2):
        assert got[(key, "und")]["score"] == 0 and got[(key, "und")]["rejected"]
    kept = I.keep_identified(odd, models)
    assert kept.columns == odd.columns
    assert all(r["text"] and r["text"].strip() for r in kept.collect())
    nonsense = spark.createDataFrame([(1, "qxzj vkwq zzxq jjkq wxyz qqqk " * 30)], "doc_id bigint, text string")
    assert I.identify(nonsense, models).first()["rejected"]


def test_language_without_training_rows(odd):
    models = I.fit_language_models(odd.where("lang = 'none'"))
    assert {r["lang_pred"] for r in I.identify(odd, models).collect()} == {"und"}


def test_kneser_ney_is_a_distribution(spark):
    docs = spark.createDataFrame([(1, "abab ab a abba", "x"), (2, "ba bab", "x")], "doc_id bigint, text string, lang string")
    model = I.fit_language_models(docs, order=3).models[0]
    # P(next | context) over the alphabet and the end mark, for a context that was seen
    total = 0.0
    for nxt in ("a", "b", "$"):
        run = "ab" + (nxt if nxt != "$" else "")
        hashes, _ = I.grams([run], 3)
        total += float(np.exp(model.score(hashes, I.context_hashes(hashes, [run]))[2]))
    assert 0.7 < total <= 1.0001


def test_quality_held_out(spark):
    found = queries.op2_quality_classifier(spark, SF).join(spark.read.parquet(f"{SF}/labels.parquet"), "doc_id").where("held_out").collect()
    assert sum(r["predicted"] == r["quality"] for r in found) >= 0.8 * len(found)
    assert all(0 <= r["score"] <= 1 for r in found)


def test_quality_edge_cases(odd, spark):
    forest = Q.fit_quality(spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet"))
    rows = Q.score_quality(odd, forest).collect()
    assert len(rows) == len(ODD) and all(0 <= r["score"] <= 1 for r in rows)
    empty = Q.fit_quality(odd, spark.createDataFrame([], "doc_id bigint, quality int"))
    assert {r["score"] for r in Q.score_quality(odd, empty).collect()} == {0.5}
    assert Q.score_quality(odd.limit(0), forest).count() == 0


def test_flattened_trees_equal_a_plain_walk():
    rng = np.random.default_rng(0)
    rows = rng.normal(size=(400, 3))
    labels = ((rows[:, 0] > 0) ^ (rows[:, 1] > 0.5)).astype(float)
    forest = Q.grow(rows, labels, trees=20, depth=3)
    for row, margin in zip(rows[:50], forest.margin(rows[:50]), strict=True):
        total = forest.base
        for feature, limit, leaf in zip(forest.feature, forest.limit, forest.leaf, strict=True):
            node = 0
            for level in range(3):
                at = (1 << level) - 1 + node
                node = 2 * node + int(row[feature[at]] > limit[at])
            total += leaf[node]
        assert abs(total - margin) < 1e-9
    assert ((forest.probability(rows) > 0.5) == (labels > 0.5)).mean() > 0.9


def test_held_out_fold_is_crc32_of_the_id(spark):
    from strandline.llm.shared import held_out

    rows = spark.range(200).select("id", held_out(F.col("id")).alias("h")).collect()
    assert all(r["h"] == (binascii.crc32(str(r["id"]).encode()) % 5 == 0) for r in rows)
