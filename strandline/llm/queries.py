"""The queries of this subpackage over the given tables, with production parameters."""

from __future__ import annotations

import zlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .line_dedup import dedup_lines

    return dedup_lines(_table(spark, sf_dir, "documents")).select("row.doc_id", "text", "n_chunks", "n_removed")


OP1_SQL = """
WITH l AS (SELECT doc_id, pos, line, CASE WHEN line = '' THEN 0 ELSE len(line) - len(replace(line, ' ', '')) + 1 END AS words, ('0x' || substr(md5(line), 1, 8))::BIGINT AS h
           FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM documents)),
c AS (SELECT *, coalesce(lag(cut) OVER w, 0) AS starts FROM (
        SELECT *, CASE WHEN words >= 16 OR lead(words) OVER w >= 16 OR (coalesce(lag(h) OVER w, 0) * 31 + h) % 2 = 0 THEN 1 ELSE 0 END AS cut
        FROM l WINDOW w AS (PARTITION BY doc_id ORDER BY pos)) WINDOW w AS (PARTITION BY doc_id ORDER BY pos)),
g AS (SELECT doc_id, k, string_agg(line, chr(10) ORDER BY pos) AS chunk, sum(words) AS words, count(*) AS n
      FROM (SELECT *, sum(starts) OVER (PARTITION BY doc_id ORDER BY pos) AS k FROM c) GROUP BY doc_id, k),
f AS (SELECT *, row_number() OVER (PARTITION BY chunk ORDER BY doc_id, k) > 1 AS again FROM g),
r AS (SELECT *, k - row_number() OVER (PARTITION BY doc_id, again ORDER BY k) AS run FROM f),
z AS (SELECT *, again AND ((sum(n) OVER w >= 2 AND sum(words) OVER w >= 12) OR sum(words) OVER w >= 16) AS gone FROM r WINDOW w AS (PARTITION BY doc_id, again, run))
SELECT d.doc_id, CASE WHEN d.text IS NULL THEN NULL ELSE coalesce(x.text, '') END AS text, coalesce(x.n_chunks, 0)::BIGINT AS n_chunks, coalesce(x.n_removed, 0)::BIGINT AS n_removed
FROM documents d LEFT JOIN (SELECT doc_id, string_agg(chunk, chr(10) ORDER BY k) FILTER (NOT gone) AS text, count(*) AS n_chunks, count(*) FILTER (gone) AS n_removed FROM z GROUP BY doc_id) x USING (doc_id)
"""


def op2_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality import fit_quality, score_quality
    from .shared import held_out

    docs = _table(spark, sf_dir, "documents")
    scored = score_quality(docs, fit_quality(docs, _table(spark, sf_dir, "labels")))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")


def op3_cost_balanced_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .packing import pack_documents

    return pack_documents(_table(spark, sf_dir, "documents"), _tokenizer())


def op4_audio_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .media import covers, find_alike, sonify

    vectors = covers(_table(spark, sf_dir, "embeddings"))
    return find_alike(sonify(vectors), sonify(vectors.where("vec_id % 20 = 0")), "recording_id % 20 = 0")


def op5_vector_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .vector_search import search

    return search(_table(spark, sf_dir, "embeddings"), "vec_id % 20 = 0", k=20)


def op6_entropy_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .mixing import mix

    return mix(_table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "copies")


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .language_id import fit_language_models, identify, training_rows
    from .shared import held_out

    docs = _table(spark, sf_dir, "documents")
    found = identify(docs, fit_language_models(training_rows(docs)))
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", "cross_entropy", "rejected")


def op8_warc_archive(spark: SparkSession, sf_dir: str) -> DataFrame:
    import uuid

    from .shared import shared_dir
    from .warc import read_archive, record_fields, write_archive

    archive = write_archive(_table(spark, sf_dir, "pages"), f"{shared_dir(spark)}/archive-{uuid.uuid4().hex}")
    return record_fields(read_archive(spark, archive)).withColumnRenamed("record_key", "page_id")


OP8_SQL = """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS body FROM pages),
     d AS (SELECT page_id, octet_length(body)::BIGINT AS payload_bytes, sha256(body) AS payload_digest FROM p),
     f AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS keeper FROM d)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN payload_bytes >= 100 AND page_id <> keeper THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 100 AND page_id <> keeper THEN keeper END AS refers_to
FROM f
"""


def op9_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .jaccard_join import Similarity, jaccard_components

    return jaccard_components(_table(spark, sf_dir, "documents"), Similarity(words=3, below=90, above=100))


OP9_SQL = """
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS a FROM documents),
s AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(a) = 0 THEN [] WHEN len(a) < 3 THEN [array_to_string(a, ' ')]
         ELSE list_transform(range(1, len(a) - 1), lambda i: array_to_string(a[i:i + 2], ' ')) END) AS g FROM w),
n AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
rare AS MATERIALIZED (SELECT s.doc_id, s.g, n.n, row_number() OVER (PARTITION BY s.doc_id ORDER BY f.f, s.g) AS k
         FROM s JOIN n USING (doc_id) JOIN (SELECT g, count(*) AS f FROM s GROUP BY g) f USING (g)),
c AS MATERIALIZED (SELECT DISTINCT x.doc_id AS u, y.doc_id AS v, x.n AS nu, y.n AS nv FROM rare x JOIN rare y ON x.g = y.g AND x.doc_id < y.doc_id
         AND x.k <= x.n - (90 * x.n + 99) // 100 + 1 AND y.k <= y.n - (90 * y.n + 99) // 100 + 1 AND 100 * x.n >= 90 * y.n AND 100 * y.n >= 90 * x.n),
e AS MATERIALIZED (SELECT u, v FROM (SELECT u, v, nu, nv, (SELECT count(*) FROM s a JOIN s b ON a.g = b.g WHERE a.doc_id = u AND b.doc_id = v) AS i FROM c) WHERE 100 * i >= 90 * (nu + nv - i)),
b AS MATERIALIZED (SELECT u, v FROM e UNION SELECT v, u FROM e),
r(d, t) AS (SELECT u, v FROM b UNION SELECT r.d, b.v FROM r JOIN b ON r.t = b.u)
SELECT w.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, least(w.doc_id, coalesce(m.t, w.doc_id)) AS component_id
FROM w LEFT JOIN n USING (doc_id) LEFT JOIN (SELECT d, min(t) AS t FROM r GROUP BY d) m ON m.d = w.doc_id
"""


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .token_counts import count_tokens

    return count_tokens(_table(spark, sf_dir, "documents"), _tokenizer())


def op11_closed_syncmers(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .syncmers import fingerprint_documents

    return fingerprint_documents(_table(spark, sf_dir, "documents"))


#: The table of crc32 by byte, and the crc32 of a short text, for DuckDB.
CRC_TABLE = "SELECT list_transform(range(256), lambda n: list_reduce(list_prepend(n, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS t"


def _crc(text: str) -> str:
    data = f"list_transform(regexp_extract_all(hex(encode({text})), '..'), lambda o: ('0x' || o)::BIGINT)"
    return f"xor(list_reduce(list_prepend(4294967295, {data}), lambda c, v: xor(c >> 8, t[(xor(c, v) & 255) + 1])), 4294967295)"


def _rolled_crc(n: int) -> str:
    """The crc32 of the n bytes from a row on: crc32 is linear, so it is the xor of one looked-up value for each byte and place."""
    found = str(zlib.crc32(bytes(n)))
    for k in range(n):
        found = f"xor({found}, (SELECT u FROM places)[{256 * (n - 1 - k) + 1} + lead(v, {k}) OVER w])"
    return found


OP11_SQL = f"""
WITH RECURSIVE t AS MATERIALIZED ({CRC_TABLE}),
u(j, v, u) AS (SELECT 0, n, t[n + 1] FROM t, range(256) r(n) UNION ALL SELECT j + 1, v, xor(t[(u & 255) + 1], u >> 8) FROM u, t WHERE j < 23),
places AS MATERIALIZED (SELECT list(u ORDER BY j, v) AS u FROM u),
c AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
d AS (SELECT doc_id, text, length(text) AS n, coalesce(lead(text) OVER w, first_value(text) OVER w) AS next, coalesce(lead(doc_id) OVER w, first_value(doc_id) OVER w) AS next_id FROM c WINDOW w AS (ORDER BY doc_id DESC)),
e AS MATERIALIZED (SELECT *, left(text, n - n // 3) || left(next, n // 3) AS edited FROM d),
x AS MATERIALIZED (SELECT doc_id, 'own' AS kind, text AS body FROM e UNION ALL SELECT doc_id, 'edited', edited FROM e),
b AS (SELECT doc_id, kind, regexp_extract_all(hex(encode(body)), '..') AS o FROM x),
r AS MATERIALIZED (SELECT doc_id, kind, i, ('0x' || o)::BIGINT AS v FROM (SELECT doc_id, kind, unnest(o) AS o, generate_subscripts(o, 1) AS i FROM b)),
h AS (SELECT doc_id, kind, i, {_rolled_crc(9)} AS h FROM r WINDOW w AS (PARTITION BY doc_id, kind ORDER BY i)),
m AS (SELECT *, min(h) OVER (w ROWS BETWEEN CURRENT ROW AND 15 FOLLOWING) AS least, lead(h, 15) OVER w AS last FROM h WHERE h IS NOT NULL WINDOW w AS (PARTITION BY doc_id, kind ORDER BY i)),
a AS (SELECT doc_id, kind, i, coalesce(lead(i) OVER (PARTITION BY doc_id, kind ORDER BY i) - i, 0) AS gap FROM m WHERE last IS NOT NULL AND (h = least OR last = least)),
k AS (SELECT doc_id, kind, a.i, gap, xor({zlib.crc32(bytes(24))}, bit_xor(u)) AS crc FROM (SELECT *, unnest(range(24)) AS z FROM a) a JOIN r USING (doc_id, kind) JOIN u ON u.v = r.v AND u.j = 23 - z WHERE r.i = a.i + z GROUP BY ALL),
g AS (SELECT doc_id, kind, list((crc >> 8) * 256 + gap ORDER BY i) AS k FROM k GROUP BY ALL),
l AS MATERIALIZED (SELECT doc_id, kind, k FROM g UNION ALL SELECT doc_id, kind, [({_crc("body")} >> 8) * 256] FROM (SELECT * FROM x ANTI JOIN g USING (doc_id, kind)), t)
SELECT e.doc_id, n AS n_chars, sha256(edited) AS edited_sha256,
       array_to_string(list_transform(o.k, lambda z: printf('%08X', z)), '') AS fingerprint, array_to_string(list_transform(i.k, lambda z: printf('%08X', z)), '') AS edited_fingerprint,
       len(list_intersect(o.k, i.k)) * 2 / (len(list_distinct(o.k)) + len(list_distinct(i.k))) AS near_edited, len(list_intersect(o.k, y.k)) * 2 / (len(list_distinct(o.k)) + len(list_distinct(y.k))) AS near_next
FROM e JOIN l o ON o.doc_id = e.doc_id AND o.kind = 'own' JOIN l i ON i.doc_id = e.doc_id AND i.kind = 'edited' JOIN l y ON y.doc_id = e.next_id AND y.kind = 'own'
"""


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .spelling import spelling_variants

    return spelling_variants(_table(spark, sf_dir, "documents"))


OP12_SQL = f"""
WITH RECURSIVE t AS MATERIALIZED ({CRC_TABLE}),
w AS MATERIALIZED (SELECT doc_id, run, count(*) AS m FROM (SELECT doc_id, translate(unnest(regexp_extract_all(text, '[A-Za-z\\x{{C0}}-\\x{{FF}}]+')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run FROM documents) WHERE length(run) >= 6 GROUP BY ALL),
k AS MATERIALIZED (SELECT row_number() OVER () AS id, run, m, encode(doc_id || ':' || run) AS b FROM w),
u(j, v, u) AS (SELECT 0, n, t[n + 1] FROM t, range(256) r(n) UNION ALL SELECT j + 1, v, xor(t[(u & 255) + 1], u >> 8) FROM u, t WHERE j < (SELECT max(octet_length(b)) FROM k)),
z(j, u) AS (SELECT 0, 4294967295::BIGINT UNION ALL SELECT j + 1, xor(t[(u & 255) + 1], u >> 8) FROM z, t WHERE j < (SELECT max(octet_length(b)) FROM k)),
o AS (SELECT id, unnest(x) AS x, len(x) - generate_subscripts(x, 1) AS j FROM (SELECT id, regexp_extract_all(hex(b), '..') AS x FROM k)),
c AS (SELECT id, bit_xor(u) AS u FROM o JOIN u ON u.j = o.j AND u.v = ('0x' || x)::BIGINT GROUP BY id),
h AS (SELECT run, m, xor(xor(c.u, z.u), 4294967295) AS h FROM k JOIN c USING (id) JOIN z ON z.j = octet_length(b)),
f AS (SELECT CASE WHEN h % 199 = 0 THEN substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word, m FROM h),
a AS MATERIALIZED (SELECT word, sum(m)::BIGINT AS n FROM f WHERE length(word) >= 6 GROUP BY word HAVING sum(m) >= 5),
d AS MATERIALIZED (SELECT word, n, i, substr(word, 1, i - 1) || substr(word, i + 1) AS rest FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM a)),
p AS (SELECT x.word AS u, y.word AS v FROM d x JOIN d y ON x.rest = y.rest AND x.i = y.i AND x.word <> y.word UNION SELECT d.word, a.word FROM d JOIN a ON d.rest = a.word UNION SELECT a.word, d.word FROM d JOIN a ON d.rest = a.word),
b AS (SELECT u, count(*) AS n_near, first(v ORDER BY n DESC, v) AS best, max(n) AS best_n FROM p JOIN a ON a.word = v GROUP BY u),
s AS MATERIALIZED (SELECT word, n, coalesce(n_near, 0) AS n_near, CASE WHEN best_n >= 5 * n THEN best END AS form, CASE WHEN best_n >= 5 * n THEN best_n END AS form_n FROM a LEFT JOIN b ON b.u = a.word),
q(word, far) AS (SELECT word, word FROM s UNION ALL SELECT q.word, s.form FROM q JOIN s ON s.word = q.far WHERE s.form IS NOT NULL)
SELECT s.word, s.form, q.far AS root, s.n, s.n_near, s.form_n FROM s JOIN q ON q.word = s.word JOIN s e ON e.word = q.far WHERE e.form IS NULL
"""


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .prefix_trie import prefix_trie

    return prefix_trie(_table(spark, sf_dir, "conversations"))


OP13_SQL = f"""
WITH RECURSIVE t AS MATERIALIZED ({CRC_TABLE}),
o AS MATERIALIZED (SELECT conv_id, sha256(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) AS x, length(coalesce(text, '')) AS chars, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST) AS k FROM conversations WHERE conv_id IS NOT NULL),
i AS (SELECT DISTINCT conv_id FROM o),
h AS MATERIALIZED (SELECT conv_id, {_crc("conv_id::VARCHAR")} % 6 AS h FROM i, t),
r AS (SELECT h.conv_id, 0 AS own, o.k, x, chars FROM h JOIN o ON o.conv_id = h.conv_id - h.conv_id % 100 AND o.k <= h.h UNION ALL SELECT h.conv_id, 1, o.k, x, chars FROM h JOIN o ON o.conv_id = h.conv_id AND o.k > h.h),
p AS (SELECT conv_id, list(x ORDER BY own, k) AS xs, list(chars ORDER BY own, k) AS cs FROM r GROUP BY conv_id),
q AS MATERIALIZED (SELECT i.conv_id, coalesce(xs, []) AS xs, coalesce(cs, []) AS cs FROM i LEFT JOIN p USING (conv_id)),
m AS (SELECT conv_id, xs, cs, unnest(range(0, len(xs) + 1)) AS depth FROM q),
n AS MATERIALIZED (SELECT array_to_string(xs[1:depth], '') AS node, depth, min(conv_id) AS conv_id, count(*) AS n_convs, any_value(CASE WHEN depth = 0 THEN 0 ELSE cs[depth] END) AS chars, coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (len(xs) = depth), '') AS ends FROM m GROUP BY ALL),
c AS (SELECT left(node, 64 * (depth - 1)) AS node, count(*) AS n_children FROM n WHERE depth > 0 GROUP BY ALL),
f AS MATERIALIZED (SELECT n.*, coalesce(n_children, 0) AS n_children FROM n LEFT JOIN c USING (node)),
s AS (SELECT left(node, 64 * up) AS node, sum((n_children = 0)::BIGINT)::BIGINT AS n_leaves, sum((n_convs - 1) * chars)::BIGINT AS saved_tokens FROM (SELECT *, unnest(range(0, depth + 1)) AS up FROM f) GROUP BY ALL)
SELECT f.conv_id, f.depth, a.conv_id AS parent_conv_id, f.n_convs, f.n_children, n_leaves, saved_tokens, sha256(f.ends) AS ends_sha256
FROM f JOIN s USING (node) LEFT JOIN f a ON f.depth > 0 AND a.node = left(f.node, 64 * (f.depth - 1))
"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_line_dedup": op1_line_dedup,
        "op2_quality_classifier": op2_quality_classifier,
        "op3_cost_balanced_packing": op3_cost_balanced_packing,
        "op4_audio_fingerprints": op4_audio_fingerprints,
        "op5_vector_search": op5_vector_search,
        "op6_entropy_mixing": op6_entropy_mixing,
        "op7_language_id": op7_language_id,
        "op8_warc_archive": op8_warc_archive,
        "op9_jaccard_join": op9_jaccard_join,
        "op10_token_counts": op10_token_counts,
        "op11_closed_syncmers": op11_closed_syncmers,
        "op12_spelling_variants": op12_spelling_variants,
        "op13_prefix_trie": op13_prefix_trie,
    }


def oracle_sql() -> dict[str, str]:
    return {"op1_line_dedup": OP1_SQL, "op8_warc_archive": OP8_SQL, "op9_jaccard_join": OP9_SQL, "op11_closed_syncmers": OP11_SQL, "op12_spelling_variants": OP12_SQL, "op13_prefix_trie": OP13_SQL}
