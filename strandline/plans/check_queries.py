"""Queries of the contract checks, selections and record rules, each with its SQL.

Roles: customers are participants, orders recordings, line items clips; conversations are decision histories; violations are there or
seeded by a rule that both engines apply.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import annotation as A
from ..operators import checks as C
from ..operators import privacy as V
from ..operators import selection as P
from .bindings import FRAMES, frames, table

day = lambda c, n: F.expr(f"{c} + INTERVAL {n} DAY")


def b1_row_rules(spark: SparkSession, sf: str) -> DataFrame:
    rules = {"discount_high": F.col("l_discount") < 0.1, "quantity_low": F.col("l_quantity") > 1, "returned_open": ~((F.col("l_returnflag") == "R") & (F.col("l_linestatus") == "O")), "tax_high": F.col("l_tax") <= 0.07}
    return C.violations(table(spark, sf, "lineitem"), rules, "l_orderkey", "l_linenumber")


B1 = """SELECT 'discount_high' AS rule_id, l_orderkey, l_linenumber FROM lineitem WHERE NOT l_discount < 0.1::DOUBLE UNION ALL SELECT 'quantity_low', l_orderkey, l_linenumber FROM lineitem WHERE NOT l_quantity > 1
UNION ALL SELECT 'returned_open', l_orderkey, l_linenumber FROM lineitem WHERE l_returnflag = 'R' AND l_linestatus = 'O' UNION ALL SELECT 'tax_high', l_orderkey, l_linenumber FROM lineitem WHERE NOT l_tax <= 0.07::DOUBLE"""


def b2_bad_ids(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").withColumn("sample_id", F.concat(F.when(F.col("doc_id") % 7 == 0, "Sample_").otherwise("sample_"), F.substring(F.sha2(F.col("doc_id").cast("string"), 256), 1, 32)))
    return C.bad_ids(docs, "sample_id", "sample_[0-9a-f]{32}", "doc_id")


B2 = """SELECT doc_id, s AS sample_id FROM (SELECT doc_id, CASE WHEN doc_id % 7 = 0 THEN 'Sample_' ELSE 'sample_' END || substr(sha256(doc_id::VARCHAR), 1, 32) AS s FROM documents) WHERE s IS NULL OR NOT regexp_full_match(s, 'sample_[0-9a-f]{32}')"""


def _history(spark: SparkSession, sf: str) -> DataFrame:
    size = F.length("text")
    return table(spark, sf, "conversations").withColumn("proposal", F.when(size < 60, "other").when(size < 300, "short").otherwise("long"))


def b3_projected_annotations(spark: SparkSession, sf: str) -> DataFrame:
    return A.project_annotations(_history(spark, sf), "conv_id", "turn", "proposal")


B3 = """SELECT conv_id, arg_max(CASE WHEN len(text) < 60 THEN 'other' WHEN len(text) < 300 THEN 'short' ELSE 'long' END, turn) AS label, count(*) AS decisions, CASE count(*) WHEN 1 THEN 'draft' WHEN 2 THEN 'reviewed' ELSE 'adjudicated' END AS review_status,
  count(*) > 1 AS eligible FROM conversations GROUP BY conv_id"""


def b4_annotation_violations(spark: SparkSession, sf: str) -> DataFrame:
    return A.annotation_violations(_history(spark, sf), "conv_id", "turn", "role", "role", "turn", ("user", "assistant", "user"))


B4 = """WITH k AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS k FROM conversations), e AS (SELECT conv_id, bool_and(role = ['user', 'assistant', 'user'][least(k, 3)]) AS roles, count(DISTINCT role) AS actors, count(*) AS n FROM k GROUP BY conv_id)
SELECT 'role_order' AS rule_id, conv_id FROM e WHERE NOT roles UNION ALL SELECT 'actor_twice', conv_id FROM e WHERE actors <> n UNION ALL SELECT 'too_many', conv_id FROM e WHERE n > 3"""


def b10_normalized_labels(spark: SparkSession, sf: str) -> DataFrame:
    aliases = spark.createDataFrame([("click", "tap"), ("view", "look"), ("purchase", "buy")], "alias string, label string")
    found = A.normalize_labels(table(spark, sf, "events"), "event_type", aliases, ("error",))
    return found.groupBy("event_type", "label", "label_status").agg(F.count("*").alias("n"))


B10 = """SELECT event_type, CASE event_type WHEN 'click' THEN 'tap' WHEN 'view' THEN 'look' WHEN 'purchase' THEN 'buy' END AS label, CASE WHEN event_type = 'error' THEN 'quarantined' WHEN event_type IN ('click', 'view', 'purchase') THEN 'approved' ELSE 'unknown' END AS label_status, count(*) AS n FROM events GROUP BY ALL"""

PRIVATE = {"email": r"[A-Za-z0-9._]+@[A-Za-z0-9-]+\.[a-z]+", "path": r"/(home|Users|root)/", "uuid": r"[0-9a-f]{8}-[0-9a-f]{4}-", "utc": r"[0-9]{4}-[0-9]{2}-[0-9]{2}T[0-9]{2}"}


def b12_privacy_violations(spark: SparkSession, sf: str) -> DataFrame:
    return A.privacy_violations(table(spark, sf, "documents"), PRIVATE, "doc_id", "text", "source")


B12 = " UNION ALL ".join(f"SELECT '{n}' AS rule_id, doc_id FROM documents WHERE regexp_matches(coalesce(text, '') || chr(10) || coalesce(source, ''), '{p}')" for n, p in PRIVATE.items())


def b12_redacted(spark: SparkSession, sf: str) -> DataFrame:
    return A.redact(table(spark, sf, "documents"), PRIVATE, "text").select("doc_id", F.sha2("text", 256).alias("digest"))


def _records(spark: SparkSession, sf: str) -> DataFrame:
    """Events with a nested record: an identity three levels down, a machine path in a list, a raw UUID, an absolute time, or a text that isn't JSON."""
    e = table(spark, sf, "events").select("event_id", "event_type")
    k = F.col("event_id")
    record = F.struct(
        F.struct(F.array(F.when(k % 97 == 0, F.create_map(F.lit("Contact-Email"), F.lit("x"))).otherwise(F.create_map(F.lit("k"), F.col("event_type")))).alias("items")).alias("meta"),
        F.array(F.lit("plain"), F.when(k % 89 == 0, F.lit("C:\\Users\\a")).otherwise(F.lit("a/b"))).alias("files"),
        F.when(k % 83 == 0, F.lit("id 123e4567-e89b-12d3-a456-426614174000")).alias("ref"), F.when(k % 79 == 0, F.lit("2024-05-06T07:08:09Z")).alias("at"), k.alias("number"),
    )
    return e.withColumn("record", record)


def b12_nested_privacy(spark: SparkSession, sf: str) -> DataFrame:
    as_text = F.when(F.col("event_id") % 73 == 0, F.lit("/not/json")).otherwise(F.to_json("record"))
    return V.nested_violations(_records(spark, sf), "event_id", as_text)


B12C = """SELECT 'forbidden_key' AS rule_id, event_id, '$.meta.items[0].Contact-Email' AS path FROM events WHERE event_id % 97 = 0 AND event_id % 73 <> 0 UNION ALL SELECT 'machine_path', event_id, '$.files[1]' FROM events WHERE event_id % 89 = 0 AND event_id % 73 <> 0
UNION ALL SELECT 'raw_uuid', event_id, '$.ref' FROM events WHERE event_id % 83 = 0 AND event_id % 73 <> 0 UNION ALL SELECT 'absolute_time', event_id, '$.at' FROM events WHERE event_id % 79 = 0 AND event_id % 73 <> 0 UNION ALL SELECT 'machine_path', event_id, '$' FROM events WHERE event_id % 73 = 0"""


def b12_redacted_records(spark: SparkSession, sf: str) -> DataFrame:
    """What is left of nested records when forbidden entries are gone and forbidden texts replaced."""
    return V.redacted(_records(spark, sf), ("record",)).select("event_id", F.size(F.get("record.meta.items", F.lit(0))).alias("entries"), F.get("record.files", F.lit(1)).alias("file"), "record.ref", "record.at")


B12D = """SELECT event_id, CASE WHEN event_id % 97 = 0 THEN 0 ELSE 1 END AS entries, CASE WHEN event_id % 89 = 0 THEN '<redacted>' ELSE 'a/b' END AS file, CASE WHEN event_id % 83 = 0 THEN '<redacted>' END AS ref, CASE WHEN event_id % 79 = 0 THEN '<redacted>' END AS at FROM events"""


_redacted = "text"
for _n, _p in PRIVATE.items():
    _redacted = f"regexp_replace({_redacted}, '{_p}', '<{_n}>', 'g')"
B12B = f"SELECT doc_id, sha256({_redacted}) AS digest FROM documents"


def b15_run_violations(spark: SparkSession, sf: str) -> DataFrame:
    n = table(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.count("*").alias("outputs"), F.max("l_shipdate").alias("finished"))
    o = table(spark, sf, "orders").join(n, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    runs = o.select("o_orderkey", F.when(F.col("o_orderstatus") == "F", "success").otherwise("failure").alias("status"), F.coalesce("outputs", F.lit(0)).alias("outputs"), F.when(F.col("o_orderstatus") == "P", "partial").alias("failure"), F.col("o_orderdate").alias("started"), "finished")
    return A.run_violations(runs, "o_orderkey")


B15 = """WITH r AS (SELECT o_orderkey, o_orderstatus = 'F' AS ok, coalesce(outputs, 0) AS outputs, o_orderstatus = 'P' AS failed, o_orderdate AS started, finished FROM orders LEFT JOIN (SELECT l_orderkey, count(*) AS outputs, max(l_shipdate) AS finished FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey)
SELECT 'success_without_output' AS rule_id, o_orderkey FROM r WHERE ok AND outputs = 0 UNION ALL SELECT 'failure_without_code', o_orderkey FROM r WHERE NOT ok AND NOT failed UNION ALL SELECT 'ends_early', o_orderkey FROM r WHERE finished < started"""


def b15_metric_keys(spark: SparkSession, sf: str) -> DataFrame:
    return A.metric_key_violations(table(spark, sf, "lineitem"), "l_orderkey", "l_linenumber", "l_shipdate")


B15B = """WITH m AS (SELECT l_orderkey, l_linenumber, l_shipdate, lag(l_shipdate) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_shipdate) AS before FROM lineitem WHERE l_shipdate IS NOT NULL)
SELECT CASE WHEN l_shipdate = before THEN 'key_repeated' ELSE 'key_unsorted' END AS rule_id, l_orderkey, l_linenumber FROM m WHERE l_shipdate <= before"""


def c1_fk_violations(spark: SparkSession, sf: str) -> DataFrame:
    return C.fk_violations(table(spark, sf, "lineitem"), table(spark, sf, "orders").where("o_orderkey % 13 <> 0"), "l_orderkey", "o_orderkey", "l_orderkey", "l_linenumber")


C1 = "SELECT l_orderkey, l_linenumber FROM lineitem l WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_orderkey = l_orderkey AND o_orderkey % 13 <> 0)"


def c2_group_violations(spark: SparkSession, sf: str) -> DataFrame:
    child = table(spark, sf, "orders").withColumn("segment", F.when(F.col("o_custkey") % 10 == 0, "BUILDING").otherwise(F.lit(None))).join(table(spark, sf, "customer").select("c_custkey", F.col("c_mktsegment").alias("_seg")), F.col("o_custkey") == F.col("c_custkey"))
    child = child.select("o_orderkey", "o_custkey", F.coalesce("segment", "_seg").alias("segment"), F.pmod("o_custkey", F.lit(25)).cast("int").alias("nation"))
    return C.group_violations(child, table(spark, sf, "customer"), "o_custkey", "c_custkey", {"segment": "c_mktsegment", "nation": "c_nationkey"}, "o_orderkey")


C2 = """WITH j AS (SELECT o_orderkey, CASE WHEN o_custkey % 10 = 0 THEN 'BUILDING' ELSE c_mktsegment END AS segment, o_custkey % 25 AS nation, c_mktsegment, c_nationkey FROM orders JOIN customer ON o_custkey = c_custkey)
SELECT 'segment_differs' AS rule_id, o_orderkey FROM j WHERE segment IS DISTINCT FROM c_mktsegment UNION ALL SELECT 'nation_differs', o_orderkey FROM j WHERE nation IS DISTINCT FROM c_nationkey"""


def c3_containment_violations(spark: SparkSession, sf: str) -> DataFrame:
    parent = table(spark, sf, "orders").withColumn("until", day("o_orderdate", 900))
    child = table(spark, sf, "lineitem").withColumn("ends", day("l_shipdate", 30))
    return C.containment_violations(child, parent, "l_orderkey", "o_orderkey", ("l_shipdate", "ends"), ("o_orderdate", "until"), "l_orderkey", "l_linenumber")


C3 = """WITH j AS (SELECT * FROM lineitem JOIN orders ON l_orderkey = o_orderkey) SELECT 'starts_early' AS rule_id, l_orderkey, l_linenumber FROM j WHERE l_shipdate < o_orderdate
UNION ALL SELECT 'ends_late', l_orderkey, l_linenumber FROM j WHERE l_shipdate + INTERVAL 30 DAY > o_orderdate + INTERVAL 900 DAY"""


def c4_used_parents(spark: SparkSession, sf: str) -> DataFrame:
    return C.used_parents(table(spark, sf, "customer"), table(spark, sf, "orders").where("o_orderstatus = 'F'"), "c_custkey", "o_custkey").select("c_custkey", "c_mktsegment")


C4 = "SELECT c_custkey, c_mktsegment FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'F')"


def c5_reconciled(spark: SparkSession, sf: str) -> DataFrame:
    media = table(spark, sf, "orders").where("o_orderkey % 17 <> 0").withColumn("priority", F.when(F.col("o_orderkey") % 19 == 0, "0-NONE").otherwise(F.col("o_orderpriority")))
    return A.reconcile(table(spark, sf, "orders"), media, "o_orderkey", {"o_custkey": "o_custkey", "o_orderpriority": "priority"})


C5 = """SELECT o_orderkey, CASE WHEN o_orderkey % 17 = 0 THEN 'missing' WHEN o_orderkey % 19 = 0 AND o_orderpriority <> '0-NONE' THEN 'differs' ELSE 'matched' END AS status, CASE WHEN o_orderkey % 17 <> 0 AND o_orderkey % 19 = 0 THEN 'o_orderpriority' ELSE '' END AS differs FROM orders"""


def c12_identity_collisions(spark: SparkSession, sf: str) -> DataFrame:
    docs, bench = table(spark, sf, "documents"), table(spark, sf, "benchmark")
    digest = F.sha2(F.coalesce("text", F.lit("")), 256)
    return C.identity_collisions(("document", docs.withColumn("id", digest), "id", F.col("source")), ("benchmark", bench.withColumn("id", digest), "id", F.col("item_id")))


C12 = """WITH u AS (SELECT 'document' AS kind, sha256(coalesce(text, '')) AS identity, source AS content FROM documents UNION ALL SELECT 'benchmark', sha256(coalesce(text, '')), item_id::VARCHAR FROM benchmark)
SELECT identity, array_to_string(list_sort(list(DISTINCT kind)), ',') AS kinds, count(*) AS rows, count(DISTINCT content) AS contents FROM u GROUP BY identity HAVING count(*) > 1"""


def c12_path_collisions(spark: SparkSession, sf: str) -> DataFrame:
    """Orders as files in folders by customer, every other name in capitals."""
    o = table(spark, sf, "orders")
    name = F.concat(F.lit("folder-"), F.col("o_custkey") % 500, F.lit("/"), F.date_format("o_orderdate", "yyyy-MM"))
    return C.path_collisions(o.withColumn("path", F.when(F.col("o_orderkey") % 2 == 0, F.upper(name)).otherwise(F.lower(name))), "path", "o_orderpriority")


C12B = """SELECT 'folder-' || (o_custkey % 500) || '/' || strftime(o_orderdate, '%Y-%m') AS path, count(*) AS rows, count(DISTINCT coalesce(o_orderpriority, 'NULL')) AS contents FROM orders WHERE o_custkey IS NOT NULL AND o_orderdate IS NOT NULL
GROUP BY 1 HAVING count(DISTINCT coalesce(o_orderpriority, 'NULL')) > 1"""


def c13_inventory_diff(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").select("doc_id", F.sha2("text", 256).alias("digest"))
    found = docs.where("doc_id % 11 <> 0").select((F.col("doc_id") + F.when(F.col("doc_id") % 23 == 0, 1_000_000_000).otherwise(0)).alias("doc_id"), F.when(F.col("doc_id") % 5 == 0, F.sha2("digest", 256)).otherwise(F.col("digest")).alias("digest"))
    return C.inventory_diff(docs, found, "doc_id", "digest")


C13 = """WITH d AS (SELECT doc_id, sha256(text) AS digest FROM documents), f AS (SELECT doc_id + CASE WHEN doc_id % 23 = 0 THEN 1000000000 ELSE 0 END AS doc_id, CASE WHEN doc_id % 5 = 0 THEN sha256(digest) ELSE digest END AS digest FROM d WHERE doc_id % 11 <> 0)
SELECT coalesce(d.doc_id, f.doc_id) AS doc_id, CASE WHEN f.doc_id IS NULL THEN 'missing' WHEN d.doc_id IS NULL THEN 'extra' WHEN d.digest IS NOT DISTINCT FROM f.digest THEN 'unchanged' ELSE 'changed' END AS status FROM d FULL JOIN f ON d.doc_id = f.doc_id"""


def c17_archive_violations(spark: SparkSession, sf: str) -> DataFrame:
    media = table(spark, sf, "lineitem").groupBy("l_suppkey").agg(F.count("*").alias("members"), F.count_distinct("l_returnflag").alias("kinds"))
    archives = table(spark, sf, "supplier").withColumn("declared", F.pmod("s_suppkey", F.lit(7)) + 596)
    joined = archives.join(media, F.col("s_suppkey") == F.col("l_suppkey"), "left")
    return C.violations(joined, {"count_differs": F.coalesce("members", F.lit(0)) == F.col("declared"), "kinds_differ": F.coalesce("kinds", F.lit(0)) == 3}, "s_suppkey")


C17 = """WITH m AS (SELECT l_suppkey, count(*) AS members, count(DISTINCT l_returnflag) AS kinds FROM lineitem GROUP BY 1), j AS (SELECT s_suppkey, s_suppkey % 7 + 596 AS declared, coalesce(members, 0) AS members, coalesce(kinds, 0) AS kinds FROM supplier LEFT JOIN m ON s_suppkey = l_suppkey)
SELECT 'count_differs' AS rule_id, s_suppkey FROM j WHERE members <> declared UNION ALL SELECT 'kinds_differ', s_suppkey FROM j WHERE kinds <> 3"""


def d16_label_counts(spark: SparkSession, sf: str) -> DataFrame:
    return A.label_count_violations(table(spark, sf, "events"), "event_type", ("click", "view", "purchase", "signup", "refund", "other"))


D16 = """WITH n AS (SELECT event_type, count(*) AS n FROM events GROUP BY 1), k(l) AS (VALUES ('click'), ('view'), ('purchase'), ('signup'), ('refund'), ('other'))
SELECT coalesce(event_type, l) AS label, coalesce(n, 0) AS n, CASE WHEN l IS NULL THEN 'unknown_label' ELSE 'no_rows' END AS problem FROM n FULL JOIN k ON event_type = l WHERE l IS NULL OR n IS NULL"""


def d19_inventory_digest(spark: SparkSession, sf: str) -> DataFrame:
    from ..operators.metrics import inventory_digest

    return inventory_digest(table(spark, sf, "documents").select("doc_id", F.sha2("text", 256).alias("item")), "doc_id", "item", bucket=64)


D19 = """WITH b AS (SELECT doc_id // 64 AS bucket, sha256(string_agg(sha256(text), ',' ORDER BY doc_id)) AS d, count(*) AS n FROM documents GROUP BY 1) SELECT sha256(string_agg(d, ',' ORDER BY bucket)) AS digest, sum(n)::BIGINT AS items FROM b"""


def d21_partition_closure(spark: SparkSession, sf: str) -> DataFrame:
    o = table(spark, sf, "orders").withColumn("part", F.pmod("o_custkey", F.lit(3)))
    return o.groupBy("part").agg(F.count("*").alias("samples"), F.count_distinct("o_custkey").alias("participants"), F.count_distinct("o_orderkey").alias("recordings"), F.count_distinct("o_orderpriority").alias("sessions"))


D21 = "SELECT o_custkey % 3 AS part, count(*) AS samples, count(DISTINCT o_custkey) AS participants, count(DISTINCT o_orderkey) AS recordings, count(DISTINCT o_orderpriority) AS sessions FROM orders GROUP BY 1"


def e12_aliases(spark: SparkSession, sf: str) -> DataFrame:
    return P.alias(table(spark, sf, "orders"), "o_custkey", "signer_", 5)


E12 = "SELECT o_custkey, 'signer_' || lpad(dense_rank() OVER (ORDER BY o_custkey)::VARCHAR, 5, '0') AS alias FROM (SELECT DISTINCT o_custkey FROM orders)"


def e13_interleaved(spark: SparkSession, sf: str) -> DataFrame:
    return P.interleave(table(spark, sf, "orders"), "o_custkey", "o_orderdate", "o_orderkey").select("o_custkey", "o_orderkey", F.col("depth").cast("bigint").alias("depth"))


E13 = "SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS depth FROM orders"


def e14_quota(spark: SparkSession, sf: str) -> DataFrame:
    o = table(spark, sf, "orders").withColumn("split", F.pmod("o_custkey", F.lit(3)))
    return P.select_quota(o, 40, "o_custkey", ("o_orderdate", "o_orderkey"), "split", "o_orderpriority").select("split", "o_orderpriority", "o_custkey", "o_orderkey", F.col("place").cast("bigint").alias("place"))


E14 = """WITH f AS (SELECT o_custkey % 3 AS split, *, row_number() OVER (PARTITION BY o_custkey % 3, o_orderpriority, o_custkey ORDER BY o_orderdate, o_orderkey) AS k FROM orders),
p AS (SELECT *, row_number() OVER (PARTITION BY split, o_orderpriority ORDER BY o_orderdate, o_orderkey) AS place FROM f WHERE k = 1) SELECT split, o_orderpriority, o_custkey, o_orderkey, place FROM p WHERE place <= 40"""


def e14_shortfall(spark: SparkSession, sf: str) -> DataFrame:
    o = table(spark, sf, "orders").withColumn("nation", F.pmod("o_custkey", F.lit(25)))
    chosen = P.select_quota(o.where("o_orderkey % 31 = 0"), 20, "o_custkey", ("o_orderdate", "o_orderkey"), "nation")
    return P.quota_shortfall(chosen, o, 20, "nation")


E14B = """WITH n AS (SELECT DISTINCT o_custkey % 25 AS nation FROM orders), s AS (SELECT o_custkey % 25 AS nation, least(count(DISTINCT o_custkey), 20) AS c FROM orders WHERE o_orderkey % 31 = 0 GROUP BY 1)
SELECT nation, coalesce(c, 0) AS selected, 20 - coalesce(c, 0) AS short FROM n LEFT JOIN s USING (nation)"""


def e15_contiguity(spark: SparkSession, sf: str) -> DataFrame:
    seeded = table(spark, sf, "conversations").where("NOT (conv_id % 9 = 0 AND turn = 1)")
    return C.contiguity_violations(seeded, "turn", 0, "conv_id")


E15 = "SELECT conv_id, min(turn) AS least, max(turn) AS most, count(*) AS rows, count(DISTINCT turn) AS kinds FROM conversations WHERE NOT (conv_id % 9 = 0 AND turn = 1) GROUP BY 1 HAVING min(turn) <> 0 OR max(turn) + 1 <> count(*) OR count(DISTINCT turn) <> count(*)"


def e16_overlaps(spark: SparkSession, sf: str) -> DataFrame:
    o = table(spark, sf, "orders").withColumn("ends", day("o_orderdate", 20))
    return C.overlap_violations(o, "o_orderdate", "ends", "o_orderkey", "o_custkey")


E16 = """SELECT o_custkey, o_orderkey FROM (SELECT *, max(o_orderdate + INTERVAL 20 DAY) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM orders) WHERE o_orderdate < reach"""


def e17_attempt_chains(spark: SparkSession, sf: str) -> DataFrame:
    f = frames(spark, sf).withColumn("outcome", F.when(F.col("kind") == "purchase", "accepted").when(F.col("kind") == "error", "rejected").otherwise("retry"))
    return C.attempt_chain_violations(f, "i", "outcome", "rec")


E17 = f"""WITH {FRAMES}, o AS (SELECT rec, i, CASE kind WHEN 'purchase' THEN 'accepted' WHEN 'error' THEN 'rejected' ELSE 'retry' END AS outcome FROM frames),
w AS (SELECT *, lag(outcome) OVER v AS last, sum((outcome = 'accepted')::INT) OVER v AS won FROM o WINDOW v AS (PARTITION BY rec ORDER BY i))
SELECT 'follows_no_retry' AS rule_id, rec, i FROM w WHERE last <> 'retry' UNION ALL SELECT 'accepted_again', rec, i FROM w WHERE outcome = 'accepted' AND won <> 1"""


def e19_step_chains(spark: SparkSession, sf: str) -> DataFrame:
    steps = table(spark, sf, "conversations").withColumn("takes", F.when(F.col("turn") == 0, "raw").when(F.col("role") == "assistant", "user").otherwise("assistant"))
    return C.chain_violations(steps, "takes", "role", "turn", "conv_id")


E19 = """WITH s AS (SELECT conv_id, turn, role, CASE WHEN turn = 0 THEN 'raw' WHEN role = 'assistant' THEN 'user' ELSE 'assistant' END AS takes, lag(role) OVER w AS p, row_number() OVER w AS k FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn))
SELECT conv_id, turn FROM s WHERE k > 1 AND takes IS DISTINCT FROM p"""


def f3_first_usable(spark: SparkSession, sf: str) -> DataFrame:
    return P.first_usable(table(spark, sf, "orders"), F.col("o_totalprice") > 400_000, 5, ("o_orderdate", "o_orderkey"), "o_orderkey", "o_custkey")


F3 = """WITH r AS (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS k FROM orders) SELECT o_custkey, arg_min(o_orderkey, k) FILTER (o_totalprice > 400000) AS o_orderkey, coalesce(min(k) FILTER (o_totalprice > 400000), count(*)) AS attempts FROM r WHERE k <= 5 GROUP BY 1"""


def f4_fair_quota(spark: SparkSession, sf: str) -> DataFrame:
    found = P.fair_quota(table(spark, sf, "orders"), F.col("o_totalprice") > 250_000, 60, 500, "o_custkey", ("o_orderdate", "o_orderkey"), "o_orderpriority")
    return found.select("o_orderpriority", "o_orderkey", F.col("attempt").cast("bigint").alias("attempt"), F.col("turn").cast("bigint").alias("turn"), "accepted")


F4 = """WITH a AS (SELECT *, row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_orderdate, o_orderkey) AS attempt, o_totalprice > 250000 AS ok FROM orders), b AS (SELECT * FROM a WHERE attempt <= 500),
c AS (SELECT *, ok AND row_number() OVER (PARTITION BY o_orderpriority, o_custkey, ok ORDER BY o_orderdate, o_orderkey) = 1 AS accepted FROM b),
d AS (SELECT *, coalesce(sum(accepted::INT) OVER (PARTITION BY o_orderpriority ORDER BY attempt ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS had FROM c),
e AS (SELECT *, row_number() OVER (ORDER BY attempt, o_orderpriority) AS turn FROM d WHERE had < 60) SELECT o_orderpriority, o_orderkey, attempt, turn, accepted FROM e WHERE turn <= 500"""


def c14_transition_pairs(spark: SparkSession, sf: str) -> DataFrame:
    return P.transition_pairs(table(spark, sf, "orders"), "o_custkey", "o_orderpriority", "o_orderkey", 500)


C14 = """WITH f AS (SELECT o_custkey, o_orderkey, o_orderpriority, first_value(o_orderkey) OVER w AS first, first_value(o_orderpriority) OVER w AS l FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderkey))
SELECT o_custkey, any_value(first) AS first, min(o_orderkey) AS other FROM f WHERE o_orderpriority <> l GROUP BY 1 ORDER BY 1 LIMIT 500"""


def g1_set_difference(spark: SparkSession, sf: str) -> DataFrame:
    return C.set_difference(table(spark, sf, "customer").select(F.col("c_custkey").alias("id")), table(spark, sf, "orders").select((F.col("o_custkey") + F.when(F.col("o_custkey") % 50 == 0, 10_000_000).otherwise(0)).alias("id")), "id")


G1 = """WITH a AS (SELECT c_custkey AS id FROM customer), b AS (SELECT DISTINCT o_custkey + CASE WHEN o_custkey % 50 = 0 THEN 10000000 ELSE 0 END AS id FROM orders)
SELECT id, 'first_only' AS side FROM a WHERE id NOT IN (SELECT id FROM b) UNION ALL SELECT id, 'second_only' FROM b WHERE id NOT IN (SELECT id FROM a)"""


def g2_leakage(spark: SparkSession, sf: str) -> DataFrame:
    o = table(spark, sf, "orders").withColumn("part", F.when((F.col("o_custkey") % 5 == 0) | (F.col("o_orderkey") % 101 == 0), "test").otherwise("train"))
    return C.leakage(o, "part", "o_custkey", "o_orderkey", "o_orderpriority")


G2 = """WITH a AS (SELECT *, CASE WHEN o_custkey % 5 = 0 OR o_orderkey % 101 = 0 THEN 'test' ELSE 'train' END AS part FROM orders),
u AS (SELECT 'o_custkey' AS id_kind, o_custkey::VARCHAR AS identity, part FROM a UNION ALL SELECT 'o_orderkey', o_orderkey::VARCHAR, part FROM a UNION ALL SELECT 'o_orderpriority', o_orderpriority, part FROM a)
SELECT id_kind, identity, array_to_string(list_sort(list(DISTINCT part)), ',') AS partitions FROM u GROUP BY 1, 2 HAVING count(DISTINCT part) > 1"""


def g3_not_subset(spark: SparkSession, sf: str) -> DataFrame:
    return C.not_subset(table(spark, sf, "lineitem").select(F.col("l_suppkey").alias("id")), table(spark, sf, "supplier").where("s_acctbal > 0").select(F.col("s_suppkey").alias("id")), "id")


G3 = "SELECT DISTINCT l_suppkey AS id FROM lineitem WHERE l_suppkey NOT IN (SELECT s_suppkey FROM supplier WHERE s_acctbal > 0)"


def g4_union_with_provenance(spark: SparkSession, sf: str) -> DataFrame:
    a = table(spark, sf, "customer").select(F.col("c_custkey").alias("id"), F.lit("target").alias("kind"), "c_mktsegment")
    b = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("id"), F.lit("constructed").alias("kind"))
    return a.unionByName(b, allowMissingColumns=True)


G4 = "SELECT c_custkey AS id, 'target' AS kind, c_mktsegment FROM customer UNION ALL SELECT s_suppkey, 'constructed', NULL FROM supplier"


def m1_repeated_in_group(spark: SparkSession, sf: str) -> DataFrame:
    o = table(spark, sf, "orders").withColumn("split", F.pmod("o_custkey", F.lit(5)))
    return C.repeated_in_group(o, "o_custkey", "split", "o_orderpriority")


M1 = "SELECT o_custkey % 5 AS split, o_orderpriority, o_custkey, count(*) AS rows FROM orders GROUP BY ALL HAVING count(*) > 1"


def m2_split_violations(spark: SparkSession, sf: str) -> DataFrame:
    plan = table(spark, sf, "customer").select("c_custkey", F.pmod("c_custkey", F.lit(3)).alias("split"))
    derived = table(spark, sf, "orders").select("o_orderkey", "o_custkey", F.when(F.col("o_orderkey") % 41 == 0, 0).otherwise(F.pmod("o_custkey", F.lit(3))).alias("own"), "o_orderpriority")
    joined = derived.join(plan, F.col("o_custkey") == F.col("c_custkey"), "left")
    return C.violations(joined, {"split_differs": F.col("own").eqNullSafe(F.col("split")), "transition_in_test": ~((F.col("split") == 2) & (F.col("o_orderpriority") == "5-LOW"))}, "o_orderkey")


M2 = """WITH j AS (SELECT o_orderkey, CASE WHEN o_orderkey % 41 = 0 THEN 0 ELSE o_custkey % 3 END AS own, c_custkey % 3 AS split, o_orderpriority FROM orders LEFT JOIN customer ON o_custkey = c_custkey)
SELECT 'split_differs' AS rule_id, o_orderkey FROM j WHERE own IS DISTINCT FROM split UNION ALL SELECT 'transition_in_test', o_orderkey FROM j WHERE split = 2 AND o_orderpriority = '5-LOW'"""


def h1_rounding(spark: SparkSession, sf: str) -> DataFrame:
    li = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_quantity").cast("bigint").alias("n"), F.round(F.col("l_extendedprice") * 100).cast("bigint").alias("d"))
    signed = F.when(F.col("l_orderkey") % 2 == 0, F.col("n")).otherwise(-F.col("n"))
    return li.select("l_orderkey", "l_linenumber", S.ratio_ppm("n", "d").alias("ppm"), S.ratio_half_up(F.col("d"), F.col("n")).alias("half_up"), S.ratio_half_away(signed * 5, F.lit(2)).alias("away"))


H1 = """WITH l AS (SELECT l_orderkey, l_linenumber, l_quantity::BIGINT AS n, round(l_extendedprice * 100)::BIGINT AS d FROM lineitem)
SELECT l_orderkey, l_linenumber, (2 * n * 1000000 + d) // (2 * d) AS ppm, (2 * d + n) // (2 * n) AS half_up, CASE WHEN l_orderkey % 2 = 0 THEN (10 * n + 2) // 4 ELSE -((10 * n + 2) // 4) END AS away FROM l"""


def h3_iou(spark: SparkSession, sf: str) -> DataFrame:
    f = frames(spark, sf)
    return f.select("rec", "i", S.iou_ppm(F.col("t"), F.col("t") + 1000 + F.col("q"), F.lit(5_000_000) + F.col("t"), F.lit(60_000_000) + F.col("t")).alias("iou"))


H3 = f"""WITH {FRAMES}, a AS (SELECT rec, i, greatest(least(1000 + q, 60000000) - 5000000, 0) AS b, 1000 + q + 55000000 AS s FROM frames) SELECT rec, i, b * 1000000 // (s - b) AS iou FROM a"""


def h14_row_digests(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "labels").select("doc_id", S.row_digest("label/1", doc_id=F.col("doc_id"), quality=F.col("quality"), toxic=F.col("toxic")).alias("digest"))


H14 = """SELECT doc_id, sha256('label/1|{"doc_id":' || doc_id || ',"quality":' || coalesce(quality::VARCHAR, 'null') || ',"toxic":' || coalesce(toxic::VARCHAR, 'null') || '}') AS digest FROM labels"""


def h15_opaque_ids(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", S.opaque_id("sample_", "sample/1", F.col("source"), F.col("doc_id")).alias("sample_id"))


H15 = """SELECT doc_id, 'sample_' || substr(sha256('sample/1|' || lpad(printf('%X', strlen(source)), 8, '0') || ':' || source || lpad(printf('%X', strlen(doc_id::VARCHAR)), 8, '0') || ':' || doc_id), 1, 32) AS sample_id FROM documents"""


def h16_relative_ms(spark: SparkSession, sf: str) -> DataFrame:
    f = frames(spark, sf)
    least = f.agg(F.min("us").alias("zero"))
    return f.crossJoin(F.broadcast(least)).select("rec", "i", F.greatest(S.div(F.col("us") - F.col("zero"), F.lit(1000)), F.lit(0)).alias("offset_ms"))


H16 = f"""WITH {FRAMES} SELECT rec, i, (us - min(us) OVER ()) // 1000 AS offset_ms FROM frames"""


def h17_paths(spark: SparkSession, sf: str) -> DataFrame:
    p = table(spark, sf, "pages").withColumn("path", F.regexp_replace("url", "^https?://", F.lit("")))
    return p.where(~S.portable_path(F.col("path"))).select("page_id", "path")


H17 = r"""SELECT page_id, path FROM (SELECT page_id, regexp_replace(url, '^https?://', '') AS path FROM pages) WHERE regexp_matches(path, '^([A-Za-z]:|/)|\\|[\x00-\x1f\x7f]') OR len(list_filter(string_split(path, '/'), lambda x: x IN ('', '.', '..'))) > 0"""


def h18_member_tokens(spark: SparkSession, sf: str) -> DataFrame:
    p = table(spark, sf, "pages").withColumn("parts", F.split(F.regexp_replace("url", r"[?#].*$", F.lit("")), "/"))
    return p.select("page_id", F.get("parts", F.lit(2)).alias("host"), F.get("parts", F.lit(3)).alias("label"), F.when(F.size("parts") == 5, F.get("parts", F.lit(4))).alias("member"))


H18 = """SELECT page_id, p[3] AS host, p[4] AS label, CASE WHEN len(p) = 5 THEN p[5] END AS member FROM (SELECT page_id, string_split(regexp_replace(url, '[?#].*$', ''), '/') AS p FROM pages)"""


def h19_props(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events").withColumn("m", F.from_json("props", "map<string,bigint>"))
    return e.select("event_id", F.map_entries(F.transform_values("m", lambda k, v: v * 2)).alias("x")).select("event_id", F.explode("x").alias("x")).select("event_id", F.col("x.key").alias("name"), F.col("x.value").alias("twice"))


H19 = """SELECT event_id, 'k' AS name, 2 * (props->>'$.k')::BIGINT AS twice FROM events WHERE props->>'$.k' IS NOT NULL"""


def a9_content_addresses(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", S.content_path(F.sha2("text", 256), F.col("doc_id")).alias("path"))


A9 = "SELECT doc_id, 'objects/sha256/p-' || substr(h, 1, 2) || '/sha256-' || h || '/' || doc_id AS path FROM (SELECT doc_id, sha256(text) AS h FROM documents)"

QUERIES = {
    "b1_row_rules": (b1_row_rules, B1), "b2_bad_ids": (b2_bad_ids, B2), "b3_projected_annotations": (b3_projected_annotations, B3), "b4_annotation_violations": (b4_annotation_violations, B4), "b10_normalized_labels": (b10_normalized_labels, B10),
    "b12_privacy_violations": (b12_privacy_violations, B12), "b12_redacted": (b12_redacted, B12B), "b12_nested_privacy": (b12_nested_privacy, B12C), "b12_redacted_records": (b12_redacted_records, B12D), "b15_run_violations": (b15_run_violations, B15), "c1_fk_violations": (c1_fk_violations, C1), "c2_group_violations": (c2_group_violations, C2),
    "c3_containment_violations": (c3_containment_violations, C3), "c4_used_parents": (c4_used_parents, C4), "c5_reconciled": (c5_reconciled, C5), "c12_identity_collisions": (c12_identity_collisions, C12), "c12_path_collisions": (c12_path_collisions, C12B), "b15_metric_keys": (b15_metric_keys, B15B), "c13_inventory_diff": (c13_inventory_diff, C13),
    "c14_transition_pairs": (c14_transition_pairs, C14), "c17_archive_violations": (c17_archive_violations, C17), "d16_label_counts": (d16_label_counts, D16), "d19_inventory_digest": (d19_inventory_digest, D19), "d21_partition_closure": (d21_partition_closure, D21),
    "e12_aliases": (e12_aliases, E12), "e13_interleaved": (e13_interleaved, E13), "e14_quota": (e14_quota, E14), "e14_shortfall": (e14_shortfall, E14B), "e15_contiguity": (e15_contiguity, E15), "e16_overlaps": (e16_overlaps, E16),
    "e17_attempt_chains": (e17_attempt_chains, E17), "e19_step_chains": (e19_step_chains, E19), "f3_first_usable": (f3_first_usable, F3), "f4_fair_quota": (f4_fair_quota, F4), "g1_set_difference": (g1_set_difference, G1), "g2_leakage": (g2_leakage, G2),
    "g3_not_subset": (g3_not_subset, G3), "g4_union_with_provenance": (g4_union_with_provenance, G4), "m1_repeated_in_group": (m1_repeated_in_group, M1), "m2_split_violations": (m2_split_violations, M2), "h1_rounding": (h1_rounding, H1), "h3_iou": (h3_iou, H3),
    "h14_row_digests": (h14_row_digests, H14), "h15_opaque_ids": (h15_opaque_ids, H15), "h16_relative_ms": (h16_relative_ms, H16), "h17_paths": (h17_paths, H17), "h18_member_tokens": (h18_member_tokens, H18), "h19_props": (h19_props, H19), "a9_content_addresses": (a9_content_addresses, A9),
}
