"""Closures and cycles of directed graphs in rounds that grow with the logarithm of chains, not with their length.

Edges are (parent, child). A node with one parent hangs on it; hanging nodes are contracted into the node that their chain starts at, by
pointers that double each round, and what is left is walked edge by edge. Every round is written, so plans don't grow.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.staging import written


def _jumped(now: DataFrame) -> DataFrame:
    """Each node's pointer moved on by that of the node it points to."""
    ahead = now.select(F.col("node").alias("anchor"), F.col("anchor").alias("far"), F.col("length").alias("more"), F.col("low").alias("beyond"))
    doubled = now.join(ahead, "anchor", "left")
    return doubled.select("node", F.coalesce("far", "anchor").alias("anchor"), (F.col("length") + F.coalesce("more", F.lit(0))).alias("length"), F.least("low", "beyond").alias("low"), F.col("far").isNull().alias("done"))


def _hung(edges: DataFrame, keep: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(node, anchor, length) of all nodes with one incoming edge that aren't kept: where their chain starts and how long it is; and of those whose chain ends in a ring (node, ring), ring being its least node.

    edges: (parent, child, length), distinct and without loops. Pointers that reach as far as there are nodes and still don't end go round a ring.
    """
    single = edges.groupBy("child").agg(F.count("*").alias("n"), F.first("parent").alias("anchor"), F.first("length").alias("length")).where("n = 1")
    if keep is not None:
        single = single.join(keep.select(F.col("node").alias("child")), "child", "left_anti")
    now = written(single.select(F.col("child").alias("node"), "anchor", "length", F.col("child").alias("low"), F.lit(False).alias("done")), "hung")
    n = now.count()
    for _ in range(n.bit_length() // 2 + 1 if n else 0):
        now = written(_jumped(_jumped(now)), "hung")
        if now.where("NOT done").isEmpty():
            break
    open_ = now.where("NOT done")
    ring = open_.select(F.col("node").alias("anchor"), F.col("low").alias("ring"))
    return now.where("done").select("node", "anchor", "length"), open_.select("node", "anchor").join(ring, "anchor").select("node", "ring")


def _contracted(edges: DataFrame, hung: DataFrame, rings: DataFrame) -> DataFrame:
    """Edges between what doesn't hang, from where their parents hang; loops that this makes are kept."""
    gone = hung.select(F.col("node").alias("child")).unionByName(rings.select(F.col("node").alias("child")))
    left = edges.join(gone, "child", "left_anti")
    to = hung.select(F.col("node").alias("parent"), "anchor", F.col("length").alias("more"))
    moved = left.join(to, "parent", "left").select(F.coalesce("anchor", "parent").alias("parent"), "child", (F.col("length") + F.coalesce("more", F.lit(0))).alias("length"))
    return moved.groupBy("parent", "child").agg(F.min("length").alias("length"))


def closure(edges: DataFrame, roots: DataFrame, most_rounds: int = 10_000) -> DataFrame:
    """(root, node, depth): all nodes that edges lead to from each root, itself at depth 0; depth is the least number of edges.

    Null ends, loops and repeated edges change nothing; cycles end as nothing nearer is met.
    """
    keep = written(roots.select(F.col("root").alias("node")).where("node IS NOT NULL").distinct(), "roots")
    now = written(edges.where("parent <> child").select("parent", "child", F.lit(1).cast("bigint").alias("length")).distinct(), "edges")
    folded: list[DataFrame] = []
    while total := now.count():
        hung, rings = _hung(now, keep)
        n = hung.count()
        if not n:
            break
        folded.append(hung)
        now = written(_contracted(now, hung, rings).where("parent <> child"), "edges")
        if n * 3 < total:  # little hangs: walking on costs less than another contraction
            break
    reached = written(keep.select(F.col("node").alias("root"), "node", F.lit(0).cast("bigint").alias("depth")), "closure")
    frontier = reached
    for _ in range(most_rounds):
        step = frontier.join(now, F.col("node") == F.col("parent")).groupBy("root", F.col("child").alias("node")).agg(F.min(F.col("depth") + F.col("length")).alias("depth"))
        known = reached.withColumnRenamed("depth", "_known")
        frontier = written(step.join(known, ["root", "node"], "left").where("_known IS NULL OR depth < _known").drop("_known"), "frontier")
        if frontier.isEmpty():
            break
        reached = written(reached.unionByName(frontier).groupBy("root", "node").agg(F.min("depth").alias("depth")), "closure")
    else:
        raise RuntimeError(f"the graph is deeper than {most_rounds}")
    for hung in reversed(folded):
        below = hung.join(reached.select("root", F.col("node").alias("anchor"), "depth"), "anchor").select("root", "node", (F.col("depth") + F.col("length")).alias("depth"))
        reached = written(reached.unionByName(below), "closure")
    return reached.select("root", "node", F.col("depth").cast("int").alias("depth"))


def _swapped(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("child").alias("parent"), F.col("parent").alias("child"), "length")


def _colored(edges: DataFrame) -> DataFrame:
    """(node, color): the least node that leads to each, by minima that only changed nodes pass on."""
    colors = written(edges.select(F.col("parent").alias("node")).union(edges.select("child")).distinct().withColumn("color", F.col("node")), "colors")
    frontier = colors
    while True:
        offered = frontier.join(edges, F.col("node") == F.col("parent")).groupBy(F.col("child").alias("node")).agg(F.min("color").alias("offer"))
        frontier = written(colors.join(offered, "node").where("offer < color").select("node", F.col("offer").alias("color")), "changed")
        if frontier.isEmpty():
            return colors
        colors = written(colors.unionByName(frontier).groupBy("node").agg(F.min("color").alias("color")), "colors")


def cycle_components(edges: DataFrame, most_rounds: int = 1000) -> DataFrame:
    """(node, component) of all nodes on a cycle: component is the least node that they lead to and come back from.

    Nodes with one parent or one child are contracted, and ends are trimmed, from both sides: a cycle through them also goes through what
    they hang on. What is left is split by the least node that leads to each; where that node is met again, it is on a cycle. One node
    of each cycle is enough: its component is what it leads to and what leads to it. Nodes behind a cycle aren't in it.
    """
    plain = written(edges.where("parent IS NOT NULL AND child IS NOT NULL").select("parent", "child").distinct(), "edges")
    found = [plain.where("parent = child").select(F.col("parent").alias("root"))]
    now = written(plain.where("parent <> child").withColumn("length", F.lit(1).cast("bigint")), "edges")
    for _ in range(most_rounds):
        before = now.count()
        if not before:
            break
        for _side in range(2):
            hung, rings = _hung(now)
            found.append(written(rings.select(F.col("ring").alias("root")).distinct(), "rings"))
            moved = written(_contracted(now, hung, rings), "edges")
            found.append(moved.where("parent = child").select(F.col("parent").alias("root")))
            now = _swapped(moved.where("parent <> child"))
        inner = now.join(now.select(F.col("child").alias("parent")).distinct(), "parent", "left_semi")
        now = written(inner.join(inner.select(F.col("parent").alias("child")).distinct(), "child", "left_semi").select("parent", "child", "length"), "edges")
        if now.count() * 10 <= before * 9:
            continue
        colors = _colored(now)
        of = lambda side: colors.select(F.col("node").alias(side), F.col("color").alias(f"_{side}"))
        same = written(now.join(of("parent"), "parent").join(of("child"), "child").where("_parent = _child").select("parent", "child", "length", F.col("_parent").alias("color")), "edges")
        found.append(same.where("child = color").select(F.col("child").alias("root")).distinct())
        # what leads back to its color's node is one component, and done
        back = closure(_swapped(same), same.select(F.col("color").alias("root")).distinct()).select("node").distinct()
        rest = same.join(back.select(F.col("node").alias("parent")), "parent", "left_anti").join(back.select(F.col("node").alias("child")), "child", "left_anti")
        now = written(rest.select("parent", "child", "length"), "edges")
    else:
        raise RuntimeError("cycles didn't separate")
    roots = found[0]
    for more in found[1:]:
        roots = roots.unionByName(more)
    roots = written(roots.distinct(), "on-cycles")
    ahead = closure(plain, roots).select("root", "node")
    back = closure(plain.select(F.col("child").alias("parent"), F.col("parent").alias("child")), roots).select("root", "node")
    members = written(ahead.join(back, ["root", "node"]), "members")
    least = members.groupBy("root").agg(F.min("node").alias("component"))
    return members.join(least, "root").groupBy("node").agg(F.min("component").alias("component"))


def graph_violations(nodes: DataFrame, edges: DataFrame, node: str) -> DataFrame:
    """(rule_id, key): parents that aren't nodes (orphan_parent) and nodes on a cycle (cycle)."""
    orphans = edges.select("parent").distinct().join(nodes.select(F.col(node).alias("parent")), "parent", "left_anti")
    return orphans.select(F.lit("orphan_parent").alias("rule_id"), F.col("parent").alias("key")).unionByName(cycle_components(edges).select(F.lit("cycle").alias("rule_id"), F.col("node").alias("key")))


def root_violations(nodes: DataFrame, edges: DataFrame, node: str, root: str, source: str, split: str, partition: str) -> DataFrame:
    """(rule_id, key): nodes that come from no recording, or another than their own, or several (roots_differ), and nodes whose split or partition isn't their parent's (split_differs).

    root: the recording that a node is, NULL for derived ones; a parent without a split binds nobody. Root sets go down the edges from all
    roots at once, a row for each pair of root and node, so a node's set is never gathered.
    """
    known = written(nodes.select(node, root, source, split, partition), "lineage-nodes")
    reach = closure(edges, known.where(F.col(root).isNotNull()).select(F.col(node).alias("root")))
    names = known.where(F.col(root).isNotNull()).select(F.col(node).alias("root"), F.col(root).alias("_name"))
    sets = reach.join(names, "root").join(known.select(F.col(node).alias("node"), F.col(source).alias("_own")), "node")
    judged = sets.groupBy("node").agg(F.bool_and(F.col("_name").eqNullSafe(F.col("_own"))).alias("_ok"))
    roots = known.join(judged, F.col(node) == F.col("node"), "left").where(~F.coalesce("_ok", F.lit(False))).select(F.lit("roots_differ").alias("rule_id"), F.col(node).alias("key"))
    p = known.where(F.col(root).isNull() & F.col(split).isNotNull()).select(F.col(node).alias("parent"), F.col(split).alias("_s"), F.col(partition).alias("_p"))
    c = known.select(F.col(node).alias("child"), F.col(split).alias("_cs"), F.col(partition).alias("_cp"))
    differ = ~(F.col("_s").eqNullSafe(F.col("_cs")) & F.col("_p").eqNullSafe(F.col("_cp")))
    splits = edges.join(p, "parent").join(c, "child").where(differ).select(F.lit("split_differs").alias("rule_id"), F.col("child").alias("key")).distinct()
    return roots.unionByName(splits)
