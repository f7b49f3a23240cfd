"""Queries of lineage, consent and withdrawal over the star schema and the parts' number tree."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import checks as C
from ..operators import consent as O
from ..operators import graphs as N
from ..operators import lineage as L
from ..operators import selection as P
from .bindings import FRAMES, frames, table


def edges(spark: SparkSession, sf: str) -> DataFrame:
    """Part k descends from k div 2, and from k div 3 if 3 divides k."""
    p = table(spark, sf, "part").where("p_partkey > 1").select(F.col("p_partkey").alias("child"))
    return p.select(F.expr("child div 2").alias("parent"), "child").unionAll(p.where("child % 3 = 0").select(F.expr("child div 3").alias("parent"), "child")).distinct()


EDGES = "edges AS (SELECT p_partkey // 2 AS parent, p_partkey AS child FROM part WHERE p_partkey > 1 UNION SELECT p_partkey // 3, p_partkey FROM part WHERE p_partkey > 1 AND p_partkey % 3 = 0)"


def l4_closure(spark: SparkSession, sf: str) -> DataFrame:
    return N.closure(edges(spark, sf), spark.range(3, 8).select(F.col("id").alias("root")))


L4 = f"WITH RECURSIVE {EDGES}, r AS (SELECT k AS root, k AS node, 0 AS depth FROM range(3, 8) x(k) UNION SELECT r.root, e.child, r.depth + 1 FROM r JOIN edges e ON e.parent = r.node) SELECT root, node, min(depth)::INTEGER AS depth FROM r GROUP BY 1, 2"


#: Edges that close cycles: one long, one short, one loop.
_BACK = ((100, 12), (95, 23), (101, 101))


def _with_cycles(spark: SparkSession, sf: str) -> DataFrame:
    return edges(spark, sf).unionAll(spark.createDataFrame(_BACK, "parent bigint, child bigint"))


def l4_cycles(spark: SparkSession, sf: str) -> DataFrame:
    return N.cycle_components(_with_cycles(spark, sf))


def l4_graph_violations(spark: SparkSession, sf: str) -> DataFrame:
    return N.graph_violations(table(spark, sf, "part").where("p_partkey % 53 <> 9"), _with_cycles(spark, sf), "p_partkey")


CYCLES = f"""{EDGES}, g AS (SELECT * FROM edges UNION VALUES {", ".join(map(str, _BACK))}), s AS (SELECT * FROM (VALUES {", ".join(map(str, _BACK))}) v(tail, head)),
down AS (SELECT head, head::BIGINT AS n FROM s UNION SELECT d.head, g.child FROM down d JOIN g ON g.parent = d.n), up AS (SELECT tail, tail::BIGINT AS n FROM s UNION SELECT u.tail, g.parent FROM up u JOIN g ON g.child = u.n),
members AS (SELECT s.head, d.n FROM s JOIN down d ON d.head = s.head JOIN up u ON u.tail = s.tail AND u.n = d.n), named AS (SELECT n, min(n) OVER (PARTITION BY head) AS component FROM members)"""
L4B = f"WITH RECURSIVE {CYCLES} SELECT n AS node, min(component) AS component FROM named GROUP BY n"
L4C = f"WITH RECURSIVE {CYCLES} SELECT 'cycle' AS rule_id, n AS key FROM named GROUP BY n UNION ALL SELECT DISTINCT 'orphan_parent', parent FROM g WHERE parent NOT IN (SELECT p_partkey FROM part WHERE p_partkey % 53 <> 9)"


def c10_root_violations(spark: SparkSession, sf: str) -> DataFrame:
    """Parts 8 to 15 are recordings; the others come from half their number, each 27th also from a third. Some name a wrong source, some leave their parent's partition."""
    p = table(spark, sf, "part").where("p_partkey >= 8").select(F.col("p_partkey").alias("k"))
    own = F.expr("k div shiftleft(1L, cast(floor(log2(k)) as int) - 3)")
    nodes = p.select("k", F.when(F.col("k") < 16, F.col("k")).alias("root"), F.when(F.col("k") % 101 == 7, 8).otherwise(own).alias("source"), F.when(F.col("k") % 5 != 0, "main").alias("split"), F.when(F.col("k") % 37 == 0, "test").otherwise("train").alias("part"))
    up = p.where("k >= 16")
    lines = up.select(F.expr("k div 2").alias("parent"), F.col("k").alias("child")).unionAll(up.where("k % 27 = 0 AND k >= 24").select(F.expr("k div 3").alias("parent"), F.col("k").alias("child")))
    return N.root_violations(nodes, lines, "k", "root", "source", "split", "part")


C10B = """WITH RECURSIVE n AS (SELECT p_partkey AS k, CASE WHEN p_partkey % 101 = 7 THEN 8 ELSE p_partkey // (1::BIGINT << (floor(log2(p_partkey))::INT - 3)) END AS source, CASE WHEN p_partkey % 5 <> 0 THEN 'main' END AS split, CASE WHEN p_partkey % 37 = 0 THEN 'test' ELSE 'train' END AS part FROM part WHERE p_partkey >= 8),
l AS (SELECT k // 2 AS parent, k AS child FROM n WHERE k >= 16 UNION SELECT k // 3, k FROM n WHERE k >= 24 AND k % 27 = 0),
r AS (SELECT k AS root, k AS node FROM n WHERE k < 16 UNION SELECT r.root, l.child FROM r JOIN l ON l.parent = r.node)
SELECT 'roots_differ' AS rule_id, k AS key FROM n LEFT JOIN r ON r.node = n.k GROUP BY k, source HAVING NOT coalesce(bool_and(root = source), FALSE)
UNION ALL SELECT DISTINCT 'split_differs', child FROM l JOIN n p ON p.k = l.parent JOIN n c ON c.k = l.child WHERE p.k >= 16 AND p.split IS NOT NULL AND (p.split IS DISTINCT FROM c.split OR p.part <> c.part)"""


def c10_edge_violations(spark: SparkSession, sf: str) -> DataFrame:
    nodes = table(spark, sf, "part").where("p_partkey % 29 <> 5").select("p_partkey", "p_type")
    return L.edge_violations(nodes, edges(spark, sf), "p_partkey", ("p_type",))


C10 = f"""WITH {EDGES}, n AS (SELECT p_partkey, p_type FROM part WHERE p_partkey % 29 <> 5), j AS (SELECT e.parent, e.child, p.p_partkey AS pk, c.p_partkey AS ck, p.p_type AS pt, c.p_type AS ct FROM edges e LEFT JOIN n p ON p.p_partkey = e.parent LEFT JOIN n c ON c.p_partkey = e.child)
SELECT 'parent_missing' AS rule_id, parent, child FROM j WHERE pk IS NULL UNION ALL SELECT 'child_missing', parent, child FROM j WHERE ck IS NULL UNION ALL SELECT 'p_type_differs', parent, child FROM j WHERE pk IS NOT NULL AND ck IS NOT NULL AND pt IS DISTINCT FROM ct"""


def l6_metadata(spark: SparkSession, sf: str) -> DataFrame:
    p = table(spark, sf, "part").select("p_partkey", F.array((F.col("p_partkey") % 2).cast("bigint")).alias("ids"), F.col("p_size").alias("created"))
    return L.metadata_violations(p, edges(spark, sf), "p_partkey", "ids", "created")


L6 = f"""WITH {EDGES}, u AS (SELECT child, list_sort(list(DISTINCT parent % 2)) AS ids, max(p_size) AS newest FROM edges JOIN part ON p_partkey = parent GROUP BY 1), j AS (SELECT p_partkey, [p_partkey % 2] AS own, ids, newest, p_size FROM part JOIN u ON child = p_partkey)
SELECT 'ids_differ' AS rule_id, p_partkey FROM j WHERE own <> ids UNION ALL SELECT 'parent_newer', p_partkey FROM j WHERE newest > p_size"""


def l1_scopes(spark: SparkSession, sf: str) -> DataFrame:
    c = table(spark, sf, "customer").select("c_custkey", (F.col("c_custkey") % 2 == 0).alias("train"), (F.col("c_custkey") % 3 == 0).alias("store"), (F.col("c_custkey") % 5 == 0).alias("publish"), (F.col("c_acctbal") < 0).alias("resale"))
    return L.scope_violations(c, "c_custkey", {"train_needs_store": ("train", "store"), "publish_needs_train": ("publish", "train")}, {"resale": False})


L1 = """SELECT 'train_needs_store' AS rule_id, c_custkey FROM customer WHERE c_custkey % 2 = 0 AND c_custkey % 3 <> 0 UNION ALL SELECT 'publish_needs_train', c_custkey FROM customer WHERE c_custkey % 5 = 0 AND c_custkey % 2 <> 0 UNION ALL SELECT 'resale_fixed', c_custkey FROM customer WHERE c_acctbal < 0"""


def _consent(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    o = table(spark, sf, "orders")
    receipts = table(spark, sf, "customer").where("c_custkey % 9 <> 0").select(F.col("c_custkey").alias("receipt_id"), F.col("c_custkey").alias("participant_id"), F.lit("1996-01-01").cast("timestamp").alias("granted_at"), F.when(F.col("c_custkey") % 4 == 0, F.lit("1999-01-01").cast("timestamp")).alias("valid_until"), (F.col("c_custkey") % 2 == 0).alias("train"))
    grants = o.select(F.col("o_orderkey").alias("grant_id"), F.col("o_custkey").alias("receipt_id"), F.when(F.col("o_orderkey") % 50 == 0, F.lit(-1)).otherwise(F.col("o_custkey")).alias("participant_id"), F.col("o_orderdate").cast("timestamp").alias("issued_at"), (F.col("o_orderstatus") == "F").alias("train"))
    ended = table(spark, sf, "customer").where("c_custkey % 7 = 0").select(F.col("c_custkey").alias("receipt_id"), F.lit("1998-06-01").cast("timestamp").alias("terminated_at"))
    return grants, receipts, ended


def l2_grants(spark: SparkSession, sf: str) -> DataFrame:
    grants, receipts, _ = _consent(spark, sf)
    return L.grant_violations(grants, receipts, ("train",))


L2 = """WITH j AS (SELECT o_orderkey AS grant_id, o_custkey % 9 <> 0 AS known, o_orderkey % 50 = 0 AS odd, o_orderdate < TIMESTAMP '1996-01-01' AS early, o_orderstatus = 'F' AND o_custkey % 2 <> 0 AS wide FROM orders)
SELECT 'receipt_missing' AS rule_id, grant_id FROM j WHERE NOT known UNION ALL SELECT 'participant_differs', grant_id FROM j WHERE known AND odd UNION ALL SELECT 'issued_early', grant_id FROM j WHERE known AND early UNION ALL SELECT 'train_widened', grant_id FROM j WHERE known AND wide"""


def l3_authorized(spark: SparkSession, sf: str) -> DataFrame:
    grants, receipts, ended = _consent(spark, sf)
    return L.authorized_at(grants, receipts, ended, "train", F.col("issued_at"))


L3 = """SELECT o_orderkey AS grant_id, o_custkey % 9 <> 0 AND o_orderdate >= TIMESTAMP '1996-01-01' AND (o_custkey % 4 <> 0 OR o_orderdate < TIMESTAMP '1999-01-01') AND (o_custkey % 7 <> 0 OR o_orderdate < TIMESTAMP '1998-06-01') AND o_orderstatus = 'F' AND o_custkey % 2 = 0 AS authorized FROM orders"""


def consent_log(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame, DataFrame]:
    """Requests, grants, receipts, log and marks: a receipt a customer, a grant and a request an order. Some logs end early, some entries come after a mark that had ruled them out."""
    c, o = table(spark, sf, "customer").select(F.col("c_custkey").alias("k")), table(spark, sf, "orders").select(F.col("o_orderkey").alias("n"), F.col("o_custkey").alias("k"), F.col("o_orderdate").cast("timestamp").alias("d"), F.col("o_orderstatus").alias("s"))
    time = lambda x: F.lit(x).cast("timestamp")
    name = lambda p, x: F.concat(F.lit(p), x.cast("string"))
    odd = lambda every, value, usual: F.when(F.col("n") % every == 0, value).otherwise(usual)
    receipts = c.where("k % 9 <> 0").select(F.col("k").alias("receipt_id"), F.col("k").alias("participant_id"), name("p", F.col("k") % 3).alias("purpose_id"), name("s", F.col("k") % 4).alias("study_id"), F.lit("t1").alias("taxonomy"), time("1996-01-01").alias("granted_at"), F.when(F.col("k") % 4 == 0, time("1999-01-01")).alias("valid_until"), (F.col("k") % 2 == 0).alias("train"), (F.col("k") % 5 == 0).alias("future_research"))
    bound = F.sha2(F.concat(F.lit("future_research="), (F.col("k") % 5 == 0).cast("string"), F.lit("\ntrain="), (F.col("k") % 2 == 0).cast("string")), 256)
    grants = o.select(F.col("n").alias("grant_id"), F.col("k").alias("receipt_id"), odd(50, F.lit(-1), F.col("k")).alias("participant_id"), odd(61, F.lit("p9"), name("p", F.col("k") % 3)).alias("purpose_id"), odd(67, F.lit("s9"), name("s", F.col("k") % 4)).alias("study_id"), odd(71, F.lit("t0"), F.lit("t1")).alias("taxonomy"), odd(73, F.lit("x"), bound).alias("receipt_scope_sha256"), F.col("d").alias("issued_at"), F.date_add("d", 1).cast("timestamp").alias("captured_at"), (F.col("s") == "F").alias("train"), (F.col("n") % 2 == 0).alias("future_research"))
    requests = o.select(F.col("n").alias("request_id"), odd(50, F.lit(-1), F.col("n")).alias("grant_id"), F.lit("train").alias("permission"), F.date_add("d", 30).cast("timestamp").alias("at"), odd(31, F.lit("p8"), name("p", F.col("k") % 3)).alias("purpose_id"), odd(3, F.lit("s7"), name("s", F.col("k") % 4)).alias("study_id"))
    entry = lambda rows, event, at, recorded: rows.select(F.col("k").alias("receipt_id"), F.lit(event).alias("event"), time(at).alias("occurred_at"), time(recorded).alias("recorded_at"))
    mark = lambda rows, through, recorded: rows.select(F.col("k").alias("receipt_id"), time(through).alias("complete_through"), time(recorded).alias("recorded_at"))
    log = entry(c, "granted", "1996-01-01", "1996-01-01").unionAll(entry(c.where("k % 7 = 0"), "ended", "1998-06-01", "1998-06-02")).unionAll(entry(c.where("k % 11 = 0"), "ended", "1996-06-01", "1998-12-01")).unionAll(entry(c.where("k % 17 = 0"), "ended", "1998-09-01", "1998-12-01"))
    marks = mark(c.where("k % 13 <> 0"), "1998-07-01", "1998-07-02").unionAll(mark(c.where("k % 13 <> 0 AND k % 3 = 0"), "2000-01-01", "2000-01-02")).unionAll(mark(c.where("k % 13 = 0"), "1997-01-01", "1997-01-02"))
    return requests, grants, receipts, log, marks


SCOPES = ("train", "future_research")


def l2_receipt_grants(spark: SparkSession, sf: str) -> DataFrame:
    _, grants, receipts, log, marks = consent_log(spark, sf)
    return O.receipt_grant_violations(grants, receipts, log, marks, SCOPES)


def l3_authorizations(spark: SparkSession, sf: str) -> DataFrame:
    requests, grants, receipts, log, marks = consent_log(spark, sf)
    return O.authorizations(requests, grants, receipts, log, marks, SCOPES)


def l3_late_entries(spark: SparkSession, sf: str) -> DataFrame:
    _, _, _, log, marks = consent_log(spark, sf)
    return O.judged_log(log, marks).where("late").select("receipt_id", "event", "occurred_at")


def _state(x: str) -> str:
    through = "CASE WHEN k % 13 = 0 THEN TIMESTAMP '1997-01-01' WHEN k % 3 = 0 THEN TIMESTAMP '2000-01-01' ELSE TIMESTAMP '1998-07-01' END"
    return f"CASE WHEN {x} > {through} THEN 'unknown' WHEN (k % 7 = 0 AND {x} >= TIMESTAMP '1998-06-01') OR (k % 17 = 0 AND {x} >= TIMESTAMP '1998-09-01') THEN 'ended' WHEN {x} >= TIMESTAMP '1996-01-01' THEN 'granted' ELSE 'none' END"


ORDERS = "o AS (SELECT o_orderkey AS n, o_custkey AS k, o_orderdate::TIMESTAMP AS d, o_orderstatus = 'F' AS train, o_orderkey % 2 = 0 AS future FROM orders)"
L2B = f"""WITH {ORDERS}, g AS (SELECT *, d + INTERVAL 1 DAY AS x, k % 9 <> 0 AS known FROM o), j AS (SELECT *, {_state("x")} AS state, x >= TIMESTAMP '1996-01-01' AND (k % 4 <> 0 OR x < TIMESTAMP '1999-01-01') AS inside FROM g)
SELECT 'receipt_missing' AS rule_id, n AS grant_id FROM j WHERE NOT known UNION ALL SELECT r, n FROM (SELECT n, unnest([CASE WHEN n % 50 = 0 THEN 'participant_differs' END, CASE WHEN n % 61 = 0 THEN 'purpose_differs' END, CASE WHEN n % 67 = 0 THEN 'study_differs' END, CASE WHEN n % 71 = 0 THEN 'taxonomy_differs' END, CASE WHEN n % 73 = 0 THEN 'scope_hash_differs' END,
  CASE WHEN d < TIMESTAMP '1996-01-01' THEN 'issued_early' END, CASE WHEN train AND k % 2 <> 0 THEN 'train_widened' END, CASE WHEN future AND k % 5 <> 0 THEN 'future_research_widened' END, CASE WHEN NOT inside THEN 'captured_outside' END, CASE WHEN state = 'unknown' THEN 'log_incomplete' END, CASE WHEN state IN ('ended', 'none') THEN 'captured_ungranted' END]) AS r FROM j WHERE known) WHERE r IS NOT NULL"""
L3B = f"""WITH {ORDERS}, g AS (SELECT *, d + INTERVAL 30 DAY AS x FROM o), j AS (SELECT *, {_state("x")} AS state FROM g),
r AS (SELECT n, CASE WHEN n % 50 = 0 OR k % 9 = 0 THEN 'unknown_grant' WHEN state = 'unknown' THEN 'log_incomplete' WHEN n % 31 = 0 THEN 'other_purpose' WHEN n % 3 = 0 AND NOT (future AND k % 5 = 0) THEN 'other_study' WHEN NOT (train AND k % 2 = 0) THEN 'not_permitted'
  WHEN x < TIMESTAMP '1996-01-01' OR (k % 4 = 0 AND x >= TIMESTAMP '1999-01-01') THEN 'outside_window' WHEN state <> 'granted' THEN 'not_granted' ELSE 'granted' END AS reason FROM j)
SELECT n AS request_id, CASE WHEN reason <> 'log_incomplete' THEN reason = 'granted' END AS authorized, reason FROM r"""


def l5_withdrawal(spark: SparkSession, sf: str) -> DataFrame:
    p = table(spark, sf, "part")
    assets = p.select(F.col("p_partkey").alias("asset_id"), F.col("p_type").alias("kind"), (F.col("p_partkey") < 40).alias("is_root"), (F.col("p_partkey") % 10).alias("participant_id"))
    requests = spark.range(2, 5).select(F.concat(F.lit("req_"), "id").alias("request_id"), F.col("id").alias("participant_id"))
    return L.withdrawal_plan(requests, assets, edges(spark, sf), {"ECONOMY": "delete", "STANDARD": "retrain"}).drop("plan_id")


L5 = f"""WITH RECURSIVE {EDGES}, d AS (SELECT 'req_' || k AS request_id, p_partkey AS root FROM part, range(2, 5) x(k) WHERE p_partkey < 40 AND p_partkey % 10 = k), r AS (SELECT request_id, root AS node, 0 AS depth FROM d UNION SELECT r.request_id, e.child, r.depth + 1 FROM r JOIN edges e ON e.parent = r.node)
SELECT request_id, p_partkey AS asset_id, p_type AS kind, CASE WHEN min(depth) = 0 THEN 'direct' ELSE 'downstream' END AS reach, CASE p_type WHEN 'ECONOMY' THEN 'delete' WHEN 'STANDARD' THEN 'retrain' ELSE 'review' END AS action FROM r JOIN part ON p_partkey = node GROUP BY request_id, p_partkey, p_type"""


def l7_quarantine(spark: SparkSession, sf: str) -> DataFrame:
    f = frames(spark, sf).withColumn("outcome", F.when(F.col("kind") == "purchase", "accepted").otherwise(F.col("kind")))
    return L.quarantine(f, "outcome", "rec", "i").select("rec", "i", "outcome", F.col("place").cast("bigint").alias("place"))


L7 = f"WITH {FRAMES} SELECT rec, i, kind AS outcome, row_number() OVER (PARTITION BY rec ORDER BY i) AS place FROM frames WHERE kind <> 'purchase'"


def l8_raw_assets(spark: SparkSession, sf: str) -> DataFrame:
    return L.raw_assets(table(spark, sf, "orders"), "o_orderkey", "o_custkey")


L8 = "SELECT 'asset_' || substr(sha256('raw-asset/1|' || lpad(printf('%X', strlen(o_orderkey::VARCHAR)), 8, '0') || ':' || o_orderkey), 1, 32) AS asset_id, 'raw_recording' AS kind, o_orderkey, o_custkey FROM orders"


def l9_gates(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "documents").select(F.col("doc_id").alias("gate"), F.sha2("text", 256).alias("digest"))
    e = d.where("gate % 6 <> 0").select("gate", F.when(F.col("gate") % 10 == 1, F.lit("old")).otherwise(F.col("digest")).alias("digest"), (F.col("gate") % 8 != 3).alias("ok"))
    return L.evaluate_gates(d, e)


L9 = "SELECT doc_id AS gate, r = 'passed' AS passed, r AS reason FROM (SELECT doc_id, CASE WHEN doc_id % 6 = 0 THEN 'missing' WHEN doc_id % 10 = 1 THEN 'stale' WHEN doc_id % 8 = 3 THEN 'failed' ELSE 'passed' END AS r FROM documents)"


def l10_chain(spark: SparkSession, sf: str) -> DataFrame:
    child = table(spark, sf, "orders").select("o_orderkey", "o_custkey", F.col("o_custkey").cast("string").alias("seg_ref"))
    parent = table(spark, sf, "customer").where("c_custkey % 21 <> 0").select("c_custkey", F.when(F.col("c_custkey") % 4 == 0, "x").otherwise(F.col("c_custkey").cast("string")).alias("seg"))
    return L.chain_links(child, parent, "o_orderkey", ("o_custkey", "seg_ref"), ("c_custkey", "seg"))


L10 = "SELECT o_orderkey, CASE WHEN o_custkey % 21 = 0 THEN 'missing' WHEN o_custkey % 4 = 0 THEN 'digest_differs' ELSE 'linked' END AS status FROM orders"


def l11_counts(spark: SparkSession, sf: str) -> DataFrame:
    actual = table(spark, sf, "orders").groupBy("o_custkey").agg(F.count("*").alias("n"))
    declared = table(spark, sf, "customer").select(F.col("c_custkey").alias("o_custkey"), F.lit(10).cast("bigint").alias("n"))
    return L.reconcile_counts(declared, actual, "o_custkey")


L11 = "SELECT c_custkey AS o_custkey, 10::BIGINT AS declared, coalesce(n, 0) AS actual FROM customer LEFT JOIN (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1) ON o_custkey = c_custkey WHERE coalesce(n, 0) <> 10"


def l12_normalized_attempts(spark: SparkSession, sf: str) -> DataFrame:
    f = frames(spark, sf)
    names = P.alias(f, "rec", "session_", 4).withColumnRenamed("rec", "_r")
    zero = f.groupBy("rec").agg(F.min("us").alias("_zero")).withColumnRenamed("rec", "_z")
    joined = f.join(names, F.col("rec") == F.col("_r")).join(zero, F.col("rec") == F.col("_z"))
    label = F.when(F.col("kind").isin("click", "view"), "target").when(F.col("kind") == "error", F.lit(None)).otherwise("other")
    return joined.select("alias", "i", F.expr("(us - _zero) div 1000").alias("offset_ms"), label.alias("label"))


L12 = f"""WITH {FRAMES}, a AS (SELECT rec, 'session_' || lpad(row_number() OVER (ORDER BY rec)::VARCHAR, 4, '0') AS alias FROM (SELECT DISTINCT rec FROM frames))
SELECT alias, i, (us - min(us) OVER (PARTITION BY rec)) // 1000 AS offset_ms, CASE WHEN kind IN ('click', 'view') THEN 'target' WHEN kind = 'error' THEN NULL ELSE 'other' END AS label FROM frames JOIN a USING (rec)"""


def l13_license(spark: SparkSession, sf: str) -> DataFrame:
    s = table(spark, sf, "supplier").withColumn("allowed", F.when(F.col("s_suppkey") % 3 == 0, "train").otherwise("store")).withColumn("forbidden", F.when(F.col("s_suppkey") % 4 == 0, "train").otherwise("sell"))
    return C.violations(s, {"uses_overlap": F.col("allowed") != F.col("forbidden"), "not_accepted": F.col("s_acctbal") >= 0, "nation_unknown": F.col("s_nationkey").between(0, 24)}, "s_suppkey")


L13 = "SELECT 'uses_overlap' AS rule_id, s_suppkey FROM supplier WHERE s_suppkey % 12 = 0 UNION ALL SELECT 'not_accepted', s_suppkey FROM supplier WHERE s_acctbal < 0 UNION ALL SELECT 'nation_unknown', s_suppkey FROM supplier WHERE NOT s_nationkey BETWEEN 0 AND 24"


def l14_binding(spark: SparkSession, sf: str) -> DataFrame:
    raw = table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_orderstatus")
    bound = raw.where("o_orderkey % 37 <> 0").select(F.col("o_orderkey").alias("b_key"), "o_custkey", F.when(F.col("o_orderkey") % 43 == 0, "X").otherwise(F.col("o_orderstatus")).alias("o_orderstatus"))
    b = bound.select("b_key", F.struct("o_custkey", "o_orderstatus").alias("_b"))
    joined = raw.join(b, F.col("o_orderkey") == F.col("b_key"), "left")
    return C.violations(joined, {"unbound": F.col("b_key").isNotNull(), "facts_differ": F.col("b_key").isNull() | F.struct("o_custkey", "o_orderstatus").eqNullSafe(F.col("_b"))}, "o_orderkey")


L14 = "SELECT 'unbound' AS rule_id, o_orderkey FROM orders WHERE o_orderkey % 37 = 0 UNION ALL SELECT 'facts_differ', o_orderkey FROM orders WHERE o_orderkey % 37 <> 0 AND o_orderkey % 43 = 0 AND o_orderstatus <> 'X'"

QUERIES = {
    "l1_scopes": (l1_scopes, L1), "l2_grants": (l2_grants, L2), "l3_authorized": (l3_authorized, L3), "l2_receipt_grants": (l2_receipt_grants, L2B), "l3_authorizations": (l3_authorizations, L3B), "l3_late_entries": (l3_late_entries, "SELECT c_custkey AS receipt_id, 'ended' AS event, TIMESTAMP '1996-06-01' AS occurred_at FROM customer WHERE c_custkey % 11 = 0"), "l4_closure": (l4_closure, L4), "l4_cycles": (l4_cycles, L4B), "l4_graph_violations": (l4_graph_violations, L4C), "c10_root_violations": (c10_root_violations, C10B), "l5_withdrawal": (l5_withdrawal, L5), "l6_metadata": (l6_metadata, L6), "l7_quarantine": (l7_quarantine, L7), "l8_raw_assets": (l8_raw_assets, L8), "l9_gates": (l9_gates, L9),
    "l10_chain": (l10_chain, L10), "l11_counts": (l11_counts, L11), "l12_normalized_attempts": (l12_normalized_attempts, L12), "l13_license": (l13_license, L13), "l14_binding": (l14_binding, L14), "c10_edge_violations": (c10_edge_violations, C10),
}
