"""Line dedup, Jaccard join, mixing, archive, vector search and audio against brute force, with edge cases."""

import hashlib
import itertools
import random
import re

import numpy as np
import oracle
import pytest
from pyspark.sql import functions as F

from strandline.llm import components, jaccard_join, line_dedup, media, mixing, queries, shared, vector_search, warc

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", queries.oracle_sql())
def test_query_against_sql(spark, name):
    assert oracle.differences(queries.queries()[name](spark, SF), queries.oracle_sql()[name], oracle.connect(SF)) == []


def docs_of(spark, rows):
    return spark.createDataFrame([(k, t, "s") for k, t in rows], "doc_id bigint, text string, gone string").repartition(3)


def brute_components(rows, words, below, above):
    def grams(text):
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        return {tuple(w[k : k + words]) for k in range(max(1, len(w) - words + 1))} if w else set()

    sets = [(k, grams(t)) for k, t in rows if k is not None]
    best = {k: k for k, _ in sets}
    links = [(a, b) for (a, x), (b, y) in itertools.combinations(sets, 2) if x and y and above * len(x & y) >= below * len(x | y)]
    changed = True
    while changed:
        changed = False
        for a, b in links:
            low = min(best[a], best[b])
            if best[a] != low or best[b] != low:
                best[a] = best[b] = low
                changed = True
    return best


@pytest.mark.parametrize(("words", "below"), [(3, 90), (5, 80), (1, 50)])
def test_jaccard_components(spark, words, below):
    rng = random.Random(words)
    vocabulary = [f"w{k}" for k in range(60)]
    rows = [(0, None), (1, ""), (2, " \n "), (3, "one"), (4, "One"), (5, "two words"), (6, "TWO  words")]
    for k in range(12):
        base = [rng.choice(vocabulary) for _ in range(rng.choice([3, 8, 20, 60, 200]))]
        for _ in range(6):
            own = list(base)
            for _ in range(rng.choice([0, 1, 2, 4, 8])):
                own[rng.randrange(len(own))] = rng.choice(vocabulary)
            rows.append((len(rows), " ".join(own[: len(own) - rng.choice([0, 0, 1])])))
    rows.append((None, rows[20][1]))
    got = {r["doc_id"]: r["component_id"] for r in jaccard_join.jaccard_components(docs_of(spark, rows), jaccard_join.Similarity(words, below, 100)).collect() if r["doc_id"] is not None}
    assert got == brute_components(rows, words, below, 100)


def test_jaccard_blocks_lose_no_link(spark):
    rng = random.Random(5)
    base = [f"t{k}" for k in range(80)]
    rows = []
    for k in range(40):
        own = list(base)
        for _ in range(3):
            own[rng.randrange(80)] = f"x{rng.randrange(1000)}"
        rows.append((k, " ".join(own)))
    rule = jaccard_join.Similarity(3, 80, 100)
    got = {r["doc_id"]: r["component_id"] for r in jaccard_join.jaccard_components(docs_of(spark, rows), rule, block=7).collect()}
    assert got == brute_components(rows, 3, 80, 100)


def test_jaccard_of_nothing(spark):
    assert jaccard_join.jaccard_components(docs_of(spark, [(1, "a")]).limit(0), jaccard_join.Similarity()).count() == 0


def test_tree_bound_never_prunes_a_link():
    rng = np.random.default_rng(3)
    rule = jaccard_join.Similarity(3, 80, 100)
    sets = [np.unique(rng.integers(0, 90, rng.integers(5, 60)).astype(np.uint64)) for _ in range(120)]
    sizes = np.array([len(s) for s in sets])
    counts = jaccard_join.group_counts(np.repeat(np.arange(120), sizes), np.concatenate(sets), 120, 8)
    met = set()
    for a, b in jaccard_join.CountTree(counts, sizes, fan=4).search(counts, sizes, rule, most=500):
        met |= set(zip(a.tolist(), b.tolist(), strict=True))
    for i, j in itertools.product(range(120), repeat=2):
        same = len(np.intersect1d(sets[i], sets[j]))
        if 100 * same >= 80 * (sizes[i] + sizes[j] - same):
            assert (i, j) in met


def test_connected_components(spark):
    edges = [(k, k + 1) for k in range(30)] + [(50, 40), (50, 45), (7, 7)]
    got = {r["node"]: r["component"] for r in components.connected_components(spark.createDataFrame(edges, "u bigint, v bigint")).collect()}
    assert got == {**{k: 0 for k in range(31)}, 40: 40, 45: 40, 50: 40}


PASSAGE = "\n".join(f"the passage has a line number {k} of quite some words" for k in range(9))


def test_line_dedup_edges(spark):
    own = "\n".join(f"clean line {k}" for k in range(5))
    rows = [(1, None), (2, ""), (3, own), (4, f"{own} x\n{PASSAGE}\ntail of four"), (5, f"head of five\nand more\n{PASSAGE}"), (6, "short\nshort\nshort"), (7, "\n\n\n"), (None, PASSAGE)]
    out = {r["doc_id"]: r for r in line_dedup.dedup_lines(docs_of(spark, rows)).select("row.doc_id", "row.gone", "text", "n_chunks", "n_removed").collect()}
    assert out[1]["text"] is None and out[2]["text"] == "" and out[7]["text"] == "\n\n\n"
    assert out[3]["text"] == own and out[4]["n_removed"] == 0 and out[6]["text"] == "short\nshort\nshort"
    left = [w for w in out[5]["text"].split("\n") if "passage" in w]
    assert len(left) < 9 and out[5]["text"].startswith("head of five")  # the ends of a passage of short lines stay with their neighbours
    assert out[None]["n_removed"] > 0 and {r["gone"] for r in out.values()} == {"s"}


def test_line_dedup_catches_long_passages_wherever_they_stand(spark):
    passage = "\n".join(" ".join(f"p{k}x{j}" for j in range(18)) for k in range(3))
    rows = [(1, f"a\nb\n{passage}\nc"), (2, f"{passage}\nother end"), (3, f"x y z\n{passage}"), (4, "a\nb\nc d e\nf")]
    got = {r["doc_id"]: r["text"] for r in line_dedup.dedup_lines(docs_of(spark, rows)).select("row.doc_id", "text").collect()}
    assert got == {1: rows[0][1], 2: "other end", 3: "x y z", 4: rows[3][1]}


def test_line_dedup_of_copies_and_repeats(spark):
    text = f"{PASSAGE}\n{PASSAGE}"
    got = {r["doc_id"]: r["text"] for r in line_dedup.dedup_lines(docs_of(spark, [(1, text), (2, text)])).select("row.doc_id", "text").collect()}
    assert got[2] == "" and 0 < len(got[1]) < len(text)
    same = line_dedup.dedup_lines(docs_of(spark, [(1, PASSAGE), (1, PASSAGE)])).collect()
    assert [r["text"] for r in same] == [PASSAGE, PASSAGE]
    assert line_dedup.dedup_lines(docs_of(spark, [(1, "a")]).limit(0)).count() == 0


@pytest.mark.parametrize(("n_lines", "n_words"), [(2, 26), (4, 13), (6, 10), (10, 10), (7, 15)])
def test_passages_go_to_their_last_line_wherever_they_stand(spark, n_lines, n_words):
    rng = random.Random(n_lines)
    line = lambda n: " ".join(f"w{rng.randrange(10**6)}" for _ in range(n))
    rows, wanted = [], {}
    for k in range(40):
        passage = [line(n_words) for _ in range(n_lines)]
        own = [[line(10) for _ in range(2)] for _ in range(4)]
        rows += [(k, "\n".join(own[0] + passage + own[1])), (100 + k, "\n".join(own[2] + passage + own[3]))]
        wanted |= {k: rows[-2][1], 100 + k: "\n".join(own[2] + own[3])}
    got = {r["doc_id"]: (r["text"], r["n_removed"]) for r in line_dedup.dedup_passages(docs_of(spark, rows)).select("row.doc_id", "text", "n_removed").collect()}
    assert {k: t for k, (t, _) in got.items()} == wanted
    assert all(n == (n_lines if k >= 100 else 0) for k, (_, n) in got.items())


@pytest.mark.parametrize("most", [0, 4_000_000])
def test_passages_edges(spark, most):
    rows = [(1, None), (2, ""), (3, "short\nshort\nshort"), (4, PASSAGE), (5, f"head\n{PASSAGE}\ntail"), (6, PASSAGE), (None, PASSAGE)]
    df = line_dedup.dedup_passages(docs_of(spark, rows), most=most)
    assert line_dedup.dedup_passages(docs_of(spark, rows).limit(0), most=most).count() == 0
    got = {r["doc_id"]: (r["text"], r["n_lines"]) for r in df.select("row.doc_id", "text", "n_lines").collect()}
    assert got == {1: (None, 0), 2: ("", 1), 3: (rows[2][1], 3), 4: (PASSAGE, 9), 5: ("head\ntail", 11), 6: ("", 9), None: ("", 9)}
    assert not re.search("Python|Pandas|Arrow", df._jdf.queryExecution().executedPlan().toString())


def test_pipeline_stage_removes_whole_passages(spark):
    import corpus_pipeline

    docs = spark.createDataFrame([(1, f"a first\n{PASSAGE}\nb"), (2, f"c other\n{PASSAGE}\nd")], "doc_id bigint, text string").withColumn("n_chars", F.length("text").cast("bigint"))
    got = {r["doc_id"]: (r["text"], r["n_chars"]) for r in corpus_pipeline.line_dedup(spark, docs, SF).collect()}
    assert got[2] == ("c other\nd", 9) and PASSAGE in got[1][0]


def test_line_dedup_plan_is_native(spark):
    plan = line_dedup.dedup_lines(docs_of(spark, [(1, PASSAGE)]))._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


def test_mixing_meets_targets(spark):
    rng = random.Random(2)
    rows = [(k, " ".join("w" * 3 for _ in range(rng.choice([1, 5, 40, 300]))), rng.choice(["a", "b", "c", None, "B"])) for k in range(600)] + [(9001, None, "a"), (9002, "", "b"), (None, "x y", "c"), (5, "dup dup", "c"), (5, "dup dup", "c")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string").withColumn("size", F.lit("clash"))
    out = mixing.mix(docs, bucket_rows=20).collect()
    assert len(out) == len(rows)
    assert sorted((r["doc_id"] or -1, r["taken"]) for r in out) == sorted((r["doc_id"] or -1, r["taken"]) for r in mixing.mix(docs.repartition(5), bucket_rows=20).collect())
    by: dict = {}
    for r in out:
        assert 0 <= r["taken"] <= 2 * r["size"] and r["taken"] == r["copies"] * r["size"]
        s = by.setdefault(r["source"], [0, 0, r["target"], r["source_size"]])
        s[0] += r["size"]
        s[1] += r["taken"]
    total = sum(s[0] for s in by.values())
    assert abs(sum(s[2] for s in by.values()) - 1.5 * total) < 1e-6 * total
    for size, taken, target, said in by.values():
        assert size == said and target <= 2 * size + 1e-6 and abs(taken - target) <= max(2, 0.002 * target)


def test_mixing_of_one_source_and_of_none(spark):
    one = spark.createDataFrame([(1, "a b c", "s"), (2, "d", "s")], "doc_id bigint, text string, source string")
    assert sum(r["taken"] for r in mixing.mix(one).collect()) == 6
    assert mixing.mix(one.limit(0)).count() == 0


def test_archive_round_trip(spark):
    long, short = "<html>é" + "x" * 200, "<p>"
    rows = [(3, "http://a", long), (1, "http://b", long), (2, None, short), (4, "http://d", short), (5, "u", None), (None, "n", long), (6, "v", "WARC/1.1\r\n\r\n" * 20), (7, "w", "WARC/1.1\r\n\r\n" * 20)]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string").withColumn("payload_digest", F.lit("clash")).repartition(3)
    archive = warc.write_archive(pages, f"{shared.shared_dir(spark)}/archive-test-{random.random()}")
    records = warc.read_archive(spark, archive).collect()
    assert spark.read.parquet(archive.payloads).count() == len({r[2] or "" for r in rows})
    by = {r["record_key"]: r for r in records}
    assert len(records) == len(rows) and by[1]["record_type"] == "response" and by[3]["refers_to"] == 1 and by[None]["refers_to"] == 1
    assert by[2]["record_type"] == by[4]["record_type"] == by[5]["record_type"] == "response" and by[7]["refers_to"] == 6
    for key, _, html in rows:
        body, record = (html or "").encode(), bytes(by[key]["record"])
        assert by[key]["payload_digest"] == hashlib.sha256(body).hexdigest() and bytes(by[key]["payload"]) == body
        head, _, rest = record.partition(b"\r\n\r\n")
        length = int(re.search(rb"Content-Length: (\d+)", head)[1])
        assert rest[length:] == b"\r\n\r\n" and (rest[:length].endswith(body) if by[key]["record_type"] == "response" else body not in rest[:length] or not body)


def test_record_fields_come_from_the_record_bytes(spark):
    long = "<html>é\r\n\r\n" + "x" * 200
    rows = [(3, "http://a", long), (1, "b\r\nWARC-Type: revisit\r\n\r\n", long), (2, None, "<p>"), (5, "u", None), (None, "n", long)]
    archive = warc.write_archive(spark.createDataFrame(rows, "page_id bigint, url string, html string"), f"{shared.shared_dir(spark)}/archive-test-{random.random()}")
    records = warc.read_archive(spark, archive)
    blind = records.select(F.lit(None).cast("bigint").alias("record_key"), "record")  # nothing but the bytes
    digest = lambda t: hashlib.sha256((t or "").encode()).hexdigest()
    wanted = {(k, len((t or "").encode()), digest(t), "revisit" if k in (3, None) else "response", 1 if k in (3, None) else None) for k, _, t in rows}
    assert {tuple(r) for r in warc.record_fields(blind).collect()} == wanted
    for old, new in ((b"sha256:", b"sha256:0"), (b"Content-Length: 2", b"Content-Length: 3"), (b"WARC-Refers-To: <urn:uuid:", b"WARC-Refers-To: <urn:uuid:0")):
        damaged = [(None, bytearray(bytes(r["record"]).replace(old, new))) for r in records.collect()]
        with pytest.raises(Exception, match="header's|names no record"):
            warc.record_fields(spark.createDataFrame(damaged, "record_key bigint, record binary")).collect()


def test_archive_refuses_a_changed_payload(spark):
    pages = spark.createDataFrame([(1, "u", "x" * 150)], "page_id bigint, url string, html string")
    archive = warc.write_archive(pages, f"{shared.shared_dir(spark)}/archive-test-{random.random()}")
    stored = spark.read.parquet(archive.payloads).collect()
    spark.createDataFrame([(stored[0]["payload_digest"], bytearray(b"other"))], "payload_digest string, payload binary").write.mode("overwrite").parquet(archive.payloads)
    with pytest.raises(Exception, match="digest"):
        warc.read_archive(spark, archive).collect()


def test_vector_search_recall_and_order(spark):
    found = queries.op5_vector_search(spark, SF).toPandas()
    table = spark.read.parquet(f"{SF}/embeddings.parquet").toPandas().sort_values("vec_id")
    x, ids = np.stack(table["embedding"].to_numpy()).astype(float), table["vec_id"].to_numpy()
    hits = total = 0
    for k in np.flatnonzero(ids % 20 == 0):
        scores = x @ x[k]
        scores[k] = -np.inf
        own = found[found["query_id"] == ids[k]].sort_values("rank")
        assert own["rank"].tolist() == list(range(1, 21)) and (np.diff(own["score"]) <= 1e-12).all()
        assert np.allclose(own["score"], scores[np.searchsorted(ids, own["vec_id"])], rtol=0, atol=1e-12)
        hits += len(set(own["vec_id"]) & set(ids[np.argsort(-scores, kind="stable")[:20]]))
        total += 20
    assert hits >= 0.9 * total


def test_vector_search_edges(spark):
    rows = [(0, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [1.0, 0.0]), (3, [0.0, 0.0]), (4, None), (5, [float("nan"), 1.0]), (6, [None, 1.0]), (20, [0.5, 0.5]), (20, [0.5, 0.5]), (7, [float("inf"), 0.0]), (None, [1.0, 1.0]), (8, [3.0, 0.0])]
    table = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>").withColumn("score", F.lit(1))
    got = vector_search.search(table, "vec_id % 20 = 0", k=20).orderBy("query_id", "rank").collect()
    assert [(r["query_id"], r["vec_id"]) for r in got] == [(0, 8), (0, 1), (0, 2), (0, 20), (20, 8), (20, 0), (20, 1), (20, 2)]
    assert vector_search.search(table.limit(0), "vec_id % 20 = 0").count() == 0


def tone(notes, rate=2000):
    t = np.arange(int(rate * 0.15)) / rate
    return np.concatenate([np.sin(2 * np.pi * 110 * 2 ** (p / 12) * t) * 9000 for p in notes]).astype("<i2").tobytes()


def test_audio_alignment(spark):
    rng = random.Random(4)
    song = [rng.randrange(24) for _ in range(40)]
    other = [rng.randrange(24) for _ in range(40)]
    lead = [3, 17, 9, 20]
    rows = [(0, tone(song)), (1, tone(lead + song)), (2, tone(other)), (3, None), (4, b""), (5, b"\x00"), (6, tone(song)), (None, tone(song))]
    prints = media.fingerprint(spark.createDataFrame(rows, "recording_id bigint, pcm binary"))
    by = {r["recording_id"]: r["fingerprint"] for r in prints.collect()}
    assert by[3] == by[4] == by[5] == [] and by[0] == by[6] and all(0 <= v < 2**32 for v in by[0])
    got = {r["match_id"]: r for r in media.align(prints, "recording_id = 0").collect()}
    assert set(got) == {0, 1}
    assert got[0]["bit_error"] == 0 and got[1]["bit_error"] < 0.15
    assert abs(got[1]["offset"] - 4 * 0.15 * 2000 / 128) <= 2  # the lead's length in frames
    strict = {r["match_id"]: r for r in media.align(prints, "recording_id = 0", gap=2, least_votes=1).collect()}
    assert strict[0]["bit_error"] == 0 and set(strict) <= {0, 1}
    assert media.align(prints.limit(0), "recording_id = 0").count() == 0


def test_audio_search_finds_shifted_and_changed_recordings(spark):
    rng = np.random.default_rng(11)
    rows, wanted = [], []
    for k in range(24):
        x = rng.normal(size=64)
        x /= np.linalg.norm(x)
        y = x.copy()
        y[rng.choice(64, 1 + k % 8, False)] = rng.normal(size=1 + k % 8) * 0.125
        rows += [(20 * k, x.tolist()), (20 * k + 1, y.tolist())]
        lead = [hashlib.md5(v.tobytes()).digest()[0] % 5 for v in (x, y)]
        wanted.append((20 * k, 20 * k + 1, (lead[0] - lead[1]) % 2))
    assert {0, 1} == {odd for *_, odd in wanted}  # whole hops and half hops
    vectors = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")
    out = media.find_alike(media.sonify(vectors), media.sonify(vectors.where("vec_id % 20 = 0")), "recording_id % 20 = 0").collect()
    got = {(r["query_id"], r["match_id"]): r["half"] for r in out}
    assert {(q, m) for q, m, _ in wanted} | {(q, q) for q, *_ in wanted} <= set(got)
    assert [got[q, m] for q, m, _ in wanted] == [odd for *_, odd in wanted]
    assert {(q, m) for q, m in got if q // 20 != m // 20} == set()


def brute_alignment(asking, base, least_votes=3, most_errors=0.25, least_overlap=16, least_share=0.5):
    """The best of all offsets of two fingerprints (asking: at whole and at half hops), by counting equal integers pair by pair, or None."""

    def voters(print_):
        return [(k, v) for k, v in enumerate(print_) if not k or print_[k - 1] != v]

    votes: dict = {}
    for half, own in enumerate(asking):
        for (i, a), (j, b) in itertools.product(voters(own), voters(base)):
            if a == b:
                votes[(j - i, half)] = votes.get((j - i, half), 0) + 1
    ranked = sorted((-n, abs(o), o, half) for (o, half), n in votes.items() if n >= least_votes)
    if not ranked:
        return None
    n, _, offset, half = ranked[0]
    pairs = [(a, base[k + offset]) for k, a in enumerate(asking[half]) if 0 <= k + offset < len(base)]
    error = sum((a ^ b).bit_count() for a, b in pairs) / (32 * max(len(pairs), 1))
    whole = min(len(asking[half]), len(base))
    return (offset, half, -n, len(pairs), round(error, 6)) if len(pairs) >= max(least_overlap, least_share * whole) and error <= most_errors else None


def test_audio_query_against_brute_force(spark):
    vectors = media.covers(spark.read.parquet(f"{SF}/embeddings.parquet"))
    levels = media.fit_levels(media.sonify(vectors))
    whole = {r["recording_id"]: r["fingerprint"] for r in media.fingerprint(media.sonify(vectors), levels=levels).collect()}
    later = {r["recording_id"]: r["fingerprint"] for r in media.fingerprint(media.sonify(vectors), skip=64, levels=levels).collect()}
    wanted, same = set(), 0
    for q in sorted(k for k in whole if k % 20 == 0):
        for m in sorted(whole):
            if whole[q] == whole[m]:
                if m == min(k for k in whole if whole[k] == whole[q]):
                    wanted.add((q, m, 0, 0, len(whole[q]), len(whole[q]), 0.0))
            elif (found := brute_alignment((whole[q], later[q]), whole[m])) is not None:
                wanted.add((q, m, *found))
                same += q // 4 == m // 4
    out = queries.op4_audio_fingerprints(spark, SF).select("query_id", "match_id", "offset", "half", "votes", "overlap", "bit_error").collect()
    assert {tuple(r) for r in out} == wanted and len(out) == len(wanted)
    # most rows are matches between different recordings, and nearly all versions of a melody are found
    asked = len({q for q, *_ in wanted})
    assert same >= 0.9 * 3 * asked and len(wanted) - asked - same <= 0.1 * len(wanted)


def test_covers_edges(spark):
    rows = [(0, [1.0, 2.0]), (1, [3.0, 4.0]), (2, None), (None, [5.0]), (5, [None, 7.0]), (5, [None, 7.0]), (6, [1.0, 1.0, 1.0])]
    table = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>").withColumn("_g", F.lit(1))
    got = media.covers(table, own=10**9).collect()
    assert len(got) == len(rows) and {(r[0], tuple(r[1]) if r[1] is not None else None) for r in got} == {(0, (1.0, 2.0)), (1, (1.0, 2.0)), (2, None), (None, (5.0,)), (5, (None, 7.0)), (6, (1.0, 7.0, 1.0))}
    assert media.covers(table.limit(0)).count() == 0


def test_integral_image_filters_equal_plain_sums():
    rng = np.random.default_rng(1)
    image = rng.random((20, 12))
    got = media.packed(image)
    whole = [0] * len(got)
    for at in range(len(got)):
        for kind, low, high, width in media.FILTERS:
            part = image[at : at + width, low : low + high]
            h, w = high // 2, width // 2
            if kind == 1:
                a, b = part[:, :h].sum(), part[:, h:].sum()
            elif kind == 2:
                a, b = part[:w].sum(), part[w:].sum()
            elif kind == 3:
                a, b = part[:w, :h].sum() + part[w:, h:].sum(), part[:w, h:].sum() + part[w:, :h].sum()
            elif kind == 4:
                a = part[:, high // 3 : 2 * (high // 3)].sum()
                b = part[:, : high // 3].sum() + part[:, 2 * (high // 3) :].sum()
            else:
                a = part[width // 3 : 2 * (width // 3)].sum()
                b = part[: width // 3].sum() + part[2 * (width // 3) :].sum()
            level = int(np.digitize(np.log((1 + a) / (1 + b)), media.LEVELS))
            whole[at] = (whole[at] << 2 | (0, 1, 3, 2)[level]) & 0xFFFFFFFF
    assert got.tolist() == whole


def test_fitted_levels_split_each_filter_evenly(spark):
    vectors = media.covers(spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet"))
    recordings = media.sonify(vectors)
    levels = media.fit_levels(recordings)
    assert np.array_equal(levels, media.fit_levels(recordings.repartition(3)))
    prints = [np.array(r["fingerprint"], np.uint32) for r in media.fingerprint(recordings, levels=levels).collect()]
    rng = np.random.default_rng(1)
    pairs = [(prints[a], prints[b]) for a, b in rng.integers(0, len(prints), (2000, 2)) if abs(int(a) - int(b)) > 8]
    errors = [np.bitwise_count(a[:40] ^ b[:40]).mean() / 32 for a, b in pairs]
    assert np.mean(errors) > 0.45 and np.quantile(errors, 0.001) > 0.3
    assert media.fit_levels(recordings.limit(0)).shape == (16, 3)


def test_levels_are_quartiles_of_all_recordings(spark):
    rng = np.random.default_rng(3)
    sounds = [(k, (rng.normal(0, 3000, 2048) + 9000 * np.sin(np.arange(2048) * rng.uniform(0.3, 2))).astype("<i2").tobytes()) for k in range(900)]
    # the same values whatever the ids are; null, empty and short recordings have no frame, null ids take no part
    odd = [(None, sounds[0][1]), (900, None), (901, b""), (902, b"abc")]
    values = np.concatenate([media.filter_values(media.chroma(np.frombuffer(data, "<i2"), 2000, 512, 128)) for _, data in sounds], axis=1)
    ranked = np.sort(values, axis=1)[:, [-(-k * values.shape[1] // 4) - 1 for k in (1, 2, 3)]]
    for shift in (0, 10_000):
        table = spark.createDataFrame([(k if k is None else k + shift, data) for k, data in sounds + odd], "recording_id bigint, pcm binary").repartition(5)
        above = ranked - media.fit_levels(table)
        assert (above >= 0).all() and (above < 1 / media.GRID).all()
    silent = spark.createDataFrame([(1, bytes(4096))], "recording_id bigint, pcm binary")
    assert not media.fit_levels(silent).any()
