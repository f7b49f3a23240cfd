"""The prefix trie of rebuilt conversations: union-find over the common prefixes of sorted neighbours, one forest a block, merged across blocks."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import stage

#: Conversations of a block of 100 share their first turns; a prefix has at most this many.
BLOCK, MOST_SHARED = 100, 5


def rebuilt(turns: DataFrame) -> DataFrame:
    """Per conv_id: path, an array of (digest, chars) of its rebuilt turns. Null roles and texts are empty, null turns come first, and equal
    turns of a conversation are ordered by their digests. Rows without a conv_id belong to no conversation and are left out.

    A turn is known by 16 bytes of its SHA-256, so texts aren't shuffled. A conversation's turns have to fit a task.
    """
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    digest = F.unhex(F.left(F.sha2(F.concat(F.char_length(role).cast("string"), F.lit(":"), role, text), 256), F.lit(32)))
    block = F.col("conv_id") - F.col("conv_id") % BLOCK
    known = turns.where("conv_id IS NOT NULL").select("conv_id", block.alias("block"), F.struct("turn", digest.alias("digest"), F.char_length(text).alias("chars")).alias("t"))
    # dealt by block once: both the grouping by conversation and the window find their rows together
    own = known.repartition("block").groupBy("block", "conv_id").agg(F.array_sort(F.collect_list("t")).alias("t"))
    paths = own.withColumn("path", F.transform("t", lambda x: F.struct(x["digest"].alias("digest"), x["chars"].alias("chars"))))
    shared = F.max(F.when(F.col("conv_id") == F.col("block"), F.slice("path", 1, MOST_SHARED))).over(Window.partitionBy("block"))
    h = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % (MOST_SHARED + 1)).cast("int")
    both = paths.withColumn("shared", shared).withColumn("h", h)
    head = F.when(F.col("shared").isNull(), F.slice("path", 1, 0)).otherwise(F.slice("shared", 1, F.col("h")))
    return both.select("conv_id", F.concat(head, F.slice("path", F.col("h") + 1, F.greatest(F.size("path"), F.lit(1)))).alias("path"))


class Forest:
    """The trie of sorted paths of a block, built by merging components of neighbours in descending order of their common prefix.

    A component is a run of neighbours with a node on top. Merging two below depth l makes the node of that prefix the top of both; what lies
    between a component's old top and the new one are nodes with one child and the same members.
    """

    def __init__(self, paths: list[list[bytes]], chars: list[list[int]], ids: list[int]):
        self.paths, self.chars, self.ids = paths, chars, ids
        m = len(ids)
        self.up = list(range(m))
        self.lo, self.hi, self.least = list(range(m)), list(range(m)), list(ids)
        self.depth = [len(p) for p in paths]
        self.kids, self.leaves, self.saved = [0] * m, [0] * m, [0] * m
        self.below: list[list[int]] = [[] for _ in ids]  # nodes that hang right under a component's top
        self.nodes: list[tuple] = []
        self.parents: list[int] = []

    def find(self, k: int) -> int:
        while self.up[k] != k:
            self.up[k] = self.up[self.up[k]]
            k = self.up[k]
        return k

    def is_open(self, c: int) -> bool:
        """Whether a component holds the block's first or last path, so that its nodes can go on in a neighbouring block."""
        return self.lo[c] == 0 or self.hi[c] == len(self.ids) - 1

    def lift(self, c: int, depth: int) -> None:
        """Hangs a component's top under a node at `depth`: emits the nodes on the way, and leaves what is below them as sums."""
        n, first = self.hi[c] - self.lo[c] + 1, self.lo[c]
        for d in range(self.depth[c], depth, -1):
            done = not self.is_open(c)
            if done:
                self.leaves[c] += self.kids[c] == 0
                self.saved[c] += (n - 1) * self.chars[first][d - 1]
            self.nodes.append((done, d, first, self.hi[c], self.least[c], self.kids[c], self.leaves[c], self.saved[c]))
            self.parents.append(-1)
            for child in self.below[c]:
                self.parents[child] = len(self.nodes) - 1
            self.below[c] = [len(self.nodes) - 1]
            self.kids[c] = int(done)  # an open child is counted when blocks have met
        self.depth[c] = depth

    def merge(self, edge: int, depth: int) -> None:
        a, b = self.find(edge), self.find(edge + 1)
        self.lift(a, depth)
        self.lift(b, depth)
        self.up[b] = a
        self.hi[a] = self.hi[b]
        self.least[a] = min(self.least[a], self.least[b])
        for sums in (self.kids, self.leaves, self.saved):
            sums[a] += sums[b]
        fewer, more = sorted((self.below[a], self.below[b]), key=len)
        more.extend(fewer)
        self.below[a] = more

    def build(self) -> list[tuple]:
        """All nodes: (closed, depth, first, last, least, children, leaves, saved), open ones without what depends on other blocks."""
        common = [self.common(k) for k in range(len(self.ids) - 1)]
        for edge in sorted(range(len(common)), key=lambda k: -common[k]):
            self.merge(edge, common[edge])
        self.lift(self.find(0), -1)
        return self.nodes

    def common(self, k: int) -> int:
        a, b = self.paths[k], self.paths[k + 1]
        return next((d for d, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))


_COLUMNS = {"block": "bigint", "side": "string", "above": "string", "depth": "bigint", "node": "binary", "parent": "binary"} | dict.fromkeys(("conv_id", "parent_conv_id", "n", "chars", "children", "leaves", "saved"), "bigint") | {"ends": "string", "first_end": "bigint"}
_NODES = pa.schema([(c, {"bigint": pa.int64(), "string": pa.string(), "binary": pa.binary()}[t]) for c, t in _COLUMNS.items()])


def _chain(path: list[bytes]) -> list[bytes]:
    """For each depth a name of the first turns of a path."""
    names = [b""]
    for digest in path:
        names.append(hashlib.sha256(names[-1] + digest).digest()[:16])
    return names


def _forest_rows(block: int, batch: pa.RecordBatch) -> pa.RecordBatch:
    """The nodes of one block. Closed ones are whole but for the name of an open parent; open ones, which hold the block's first path (side left),
    its last (right) or both, are shares of nodes that other blocks may hold too."""
    column = batch.column("path")
    ends = np.cumsum(column.value_lengths().to_numpy(zero_copy_only=False)).tolist()
    digests, chars = column.flatten().field("digest").to_pylist(), column.flatten().field("chars").to_pylist()
    cut = list(zip([0, *ends[:-1]], ends))
    paths, sizes, ids = [digests[a:b] for a, b in cut], [chars[a:b] for a, b in cut], batch.column("conv_id").to_pylist()
    forest = Forest(paths, sizes, ids)
    nodes, last = forest.build(), len(ids) - 1
    sides = [None if n[0] else "both" if n[2] == 0 and n[3] == last else "left" if n[2] == 0 else "right" for n in nodes]
    names = {"left": _chain(paths[0]), "right": _chain(paths[last])}
    names["both"] = names["left"]
    rows = []
    for k, (done, depth, first, end, least, kids, leaves, saved) in enumerate(nodes):
        stop = first
        while stop <= end and len(paths[stop]) == depth:
            stop += 1
        listed = ",".join(map(str, ids[first:stop]))
        parent = forest.parents[k]
        open_parent = parent >= 0 and not nodes[parent][0]
        rows.append((
            block, sides[k], sides[parent] if done and open_parent else None, depth, None if done else names[sides[k]][depth], None if done or not depth else names[sides[k]][depth - 1], least, nodes[parent][4] if done and not open_parent else None,
            end - first + 1, sizes[first][depth - 1] if depth else 0, kids, leaves, saved, hashlib.sha256(listed.encode()).hexdigest() if done else listed or None, ids[first] if stop > first else None,
        ))
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), _NODES, strict=True)], schema=_NODES)


def _forests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each Arrow batch is a block, so memory is bounded by spark.sql.execution.arrow.maxRecordsPerBatch."""
    part = TaskContext.get().partitionId()
    for k, batch in enumerate(b for b in batches if b.num_rows):
        yield _forest_rows((part << 32) + k, batch)


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The SHA-256 of each node's lists, which come in order, joined by commas: a list longer than memory is hashed on the way."""
    node, state = None, None
    for batch in batches:
        nodes, found = [], []
        for name, ends in zip(batch.column("node").to_pylist(), batch.column("ends").to_pylist(), strict=True):
            if name != node:
                if state is not None:
                    nodes.append(node)
                    found.append(state.hexdigest())
                node, state = name, hashlib.sha256(ends.encode())
            else:
                state.update(b"," + ends.encode())
        yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.binary()), pa.array(found, pa.string())], names=["node", "ends_sha256"])
    if state is not None:
        yield pa.RecordBatch.from_arrays([pa.array([node], pa.binary()), pa.array([state.hexdigest()], pa.string())], names=["node", "ends_sha256"])


def prefix_trie(turns: DataFrame) -> DataFrame:
    """The trie of rebuilt conversations, a row per node: conv_id (smallest member), depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.

    Paths are dealt by ranges of (path, conv_id), so copies of one conversation, however many, spread over ranges. Each block of sorted paths
    gives its closed nodes and a few open ones, which are contracted by name: counts and sums add up, what an open node itself adds to
    those above it is counted in the first block that holds it, and summed along that block's edge.

    Repeated rows are turns of their own, null roles and texts are empty, rows without a conv_id are left out, a table without conversations
    has no nodes; other columns are ignored.
    """
    paths = stage(rebuilt(turns), "rebuilt-paths")
    sorted_paths = paths.repartitionByRange("path", "conv_id").sortWithinPartitions("path", "conv_id")
    nodes = stage(sorted_paths.mapInArrow(_forests, ", ".join(f"{c} {t}" for c, t in _COLUMNS.items())), "forests")
    shares = nodes.where("side IS NOT NULL")
    sums = [F.sum(c).alias(c) for c in ("n", "children", "leaves", "saved")]
    whole = shares.groupBy("node").agg(F.min("depth").alias("depth"), F.min("parent").alias("parent"), F.min("conv_id").alias("conv_id"), F.max("chars").alias("chars"), F.min("block").alias("owner"), *sums)
    open_children = whole.where("parent IS NOT NULL").groupBy(F.col("parent").alias("node")).agg(F.count("*").alias("more"))
    met = stage(whole.join(open_children, "node", "left").withColumn("children", F.col("children") + F.coalesce("more", F.lit(0))).drop("more"), "open-nodes")

    own = met.select("node", F.col("conv_id").alias("name"), "owner", (F.col("children") == 0).cast("bigint").alias("leaf"), ((F.col("n") - 1) * F.col("chars")).alias("spared"))
    edge = shares.select("block", "side", "depth", "node").join(own, "node")
    here = F.col("owner") == F.col("block")

    def below(value: str) -> Column:
        mine = F.when(here, F.col(value)).otherwise(F.lit(0).cast("bigint"))
        side = F.sum(mine).over(Window.partitionBy("block", "side").orderBy(F.col("depth").desc()).rangeBetween(Window.unboundedPreceding, 0))
        both = F.sum(mine).over(Window.partitionBy("block").orderBy(F.col("depth").desc()).rangeBetween(Window.unboundedPreceding, 0))
        return F.when(F.col("side") == "both", both).otherwise(side)

    added = edge.select("node", below("leaf").alias("l"), below("spared").alias("s")).groupBy("node").agg(F.sum("l").alias("l"), F.sum("s").alias("s"))
    lists = shares.where("ends IS NOT NULL").select("node", "ends", "first_end").repartition("node").sortWithinPartitions("node", "first_end")
    ends = lists.select("node", "ends").mapInArrow(_digests, "node binary, ends_sha256 string")
    above = met.select(F.col("node").alias("parent"), F.col("conv_id").alias("parent_conv_id"))
    opened = met.join(added, "node").join(ends, "node", "left").join(above, "parent", "left")
    nothing = F.lit(hashlib.sha256(b"").hexdigest())
    first = opened.select("conv_id", "depth", "parent_conv_id", F.col("n").alias("n_convs"), F.col("children").alias("n_children"), (F.col("leaves") + F.col("l")).alias("n_leaves"), (F.col("saved") + F.col("s")).alias("saved_tokens"), F.coalesce("ends_sha256", nothing).alias("ends_sha256"))

    named = edge.select("block", F.col("side").alias("above"), (F.col("depth") + 1).alias("depth"), "name")
    closed = nodes.where("side IS NULL").join(named, ["block", "above", "depth"], "left")
    rest = closed.select("conv_id", "depth", F.coalesce("parent_conv_id", "name").alias("parent_conv_id"), F.col("n").alias("n_convs"), F.col("children").alias("n_children"), F.col("leaves").alias("n_leaves"), F.col("saved").alias("saved_tokens"), F.col("ends").alias("ends_sha256"))
    return first.unionByName(rest)
