"""N-gram Jaccard join by a count-vector R-tree.

A document is its set of word n-grams. Hashed into groups, the set becomes a vector of counts, and the
overlap of two sets is at most the sum of the smaller counts. An R-tree over these points prunes whole
boxes by that bound (with the box's largest counts); pairs that survive are verified on the sets themselves.

So that no task needs all points, sets meet by their n-grams. In one order of all n-grams (those that a sample found common last,
otherwise by hash) the first n - ceil(t n) + 1 of a set of n, its prefix, hold one of the first n-grams that it shares with any set
it is linked with, so linked sets meet in a bucket of some prefix n-gram. Only what meets is compared: a bucket is searched by an
R-tree over its own points, and unlinked sets that meet by a shared passage never bring their other partners together.

Two passes keep large groups of near copies cheap. The first takes each set's four least hashes, compares neighbours in sorted order
and labels what it verifies; it may miss links. The second is complete: it takes all prefixes, but only buckets with several labels.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .components import connected_components
from .shared import byte_column, mix64, raw_bytes, slices, span_hashes, stage, word_spans

#: Groups of a count vector; sets of FINE n-grams or more also have one of four times as many, which fold onto these.
GROUPS, FINE = 128, 2048


@dataclass(frozen=True)
class Similarity:
    """Sets of `words`-word n-grams are linked if above * intersection >= below * union (a Jaccard index of below / above)."""

    words: int = 5
    below: int = 80
    above: int = 100

    def prefix(self, n: np.ndarray) -> np.ndarray:
        """How many n-grams of a set of n must be asked for: a partner shares at least ceil(below n / above) of them."""
        return np.where(n > 0, n + (-self.below * n) // self.above + 1, 0)

    def sizes_fit(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return (self.above * np.minimum(a, b)) >= (self.below * np.maximum(a, b))

    def enough(self, overlap: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether sets of a and b n-grams with this overlap, or a bound of it, are linked."""
        return (self.above + self.below) * overlap >= self.below * (a + b)


def shingles(texts: pa.Array, words: int) -> tuple[np.ndarray, np.ndarray]:
    """Owner and hash of each distinct n-gram, sorted by both. A-Z count as a-z; a text of fewer words is one n-gram; one without words has none."""
    flat, offsets = raw_bytes(texts)
    flat = flat + np.where((flat >= 65) & (flat <= 90), np.uint8(32), np.uint8(0))
    starts, ends, owner = word_spans(flat, offsets)
    hashes = span_hashes(flat, starts, ends)
    n = np.bincount(owner, minlength=len(texts))
    heads = np.cumsum(n) - n
    size = np.minimum(n, words)[owner]
    place = np.arange(len(owner)) - heads[owner]
    first = place <= n[owner] - size
    total = np.zeros(len(hashes), np.uint64)
    for k in range(words):
        at = np.minimum(np.arange(len(hashes)) + k, max(len(hashes) - 1, 0))
        total = np.where(k < size, mix64(total * np.uint64(0x9E3779B97F4A7C15) + hashes[at] + np.uint64(k + 1)), total)
    owner, total = owner[first], total[first]
    order = np.lexsort((total, owner))
    owner, total = owner[order], total[order]
    new = np.ones(len(owner), bool)
    new[1:] = (owner[1:] != owner[:-1]) | (total[1:] != total[:-1])
    return owner[new], total[new]


def _sums(values: np.ndarray, heads: np.ndarray) -> np.ndarray:
    return np.add.reduceat(values, heads) if len(heads) else np.zeros(0, np.uint64)


def prefixes(owner: np.ndarray, grams: np.ndarray, sizes: np.ndarray, rule: Similarity, common: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which n-grams are in their set's prefix, and which of all are in the sorted array `common`."""
    often = np.zeros(len(grams), bool)
    if len(common) and len(grams):
        often = common[np.minimum(np.searchsorted(common, grams), len(common) - 1)] == grams
    heads = np.cumsum(sizes) - sizes
    seen = np.cumsum(~often)
    rare_before = seen - ~often - (seen[heads] - ~often[heads] if len(grams) else 0)[owner] if len(grams) else seen
    place = np.arange(len(grams)) - heads[owner]
    rare = np.bincount(owner[~often], minlength=len(sizes))
    rank = np.where(often, rare[owner] + place - rare_before, rare_before)
    return rank < rule.prefix(sizes)[owner], often


def group_counts(owner: np.ndarray, grams: np.ndarray, sets: int, groups: int) -> np.ndarray:
    """Counts of each set's n-grams by hash group; `groups` is a power of two, and a coarser vector is the finer one folded."""
    cell = owner * groups + (mix64(grams + np.uint64(99)) & np.uint64(groups - 1)).astype(np.int64)
    return np.bincount(cell, minlength=sets * groups).reshape(sets, groups).astype(np.int32)


class Points:
    """Count vectors of sets: coarse ones of all, fine ones of the large."""

    def __init__(self, sizes: np.ndarray, coarse: np.ndarray, fine: np.ndarray):
        self.sizes, self.coarse, self.fine = sizes, coarse, fine
        self.fine_row = np.where(sizes >= FINE, np.cumsum(sizes >= FINE) - 1, -1)

    @classmethod
    def of_sets(cls, owner: np.ndarray, grams: np.ndarray, sizes: np.ndarray) -> Points:
        large = sizes >= FINE
        row = np.cumsum(large) - 1
        own = large[owner]
        return cls(sizes, group_counts(owner, grams, len(sizes), GROUPS), group_counts(row[owner[own]], grams[own], int(large.sum()), 4 * GROUPS))

    def packed(self) -> list[bytes]:
        coarse = self.coarse.astype("<u2")
        return [self.fine[f].astype("<u4").tobytes() if f >= 0 else c.tobytes() for f, c in zip(self.fine_row.tolist(), coarse)]

    @classmethod
    def unpacked(cls, sizes: np.ndarray, data: list[bytes]) -> Points:
        large = sizes >= FINE
        coarse = np.zeros((len(sizes), GROUPS), np.int32)
        fine = np.frombuffer(b"".join(d for d, x in zip(data, large) if x), "<u4").astype(np.int32).reshape(-1, 4 * GROUPS)
        coarse[~large] = np.frombuffer(b"".join(d for d, x in zip(data, large) if not x), "<u2").reshape(-1, GROUPS)
        coarse[large] = fine.reshape(-1, 4, GROUPS).sum(1)
        return cls(sizes, coarse, fine)

    def may_link(self, a: np.ndarray, b: np.ndarray, rule: Similarity) -> np.ndarray:
        """Whether the bounds by the coarse and, where both have one, the fine vectors allow pairs (a, b)."""
        out = rule.sizes_fit(self.sizes[a], self.sizes[b])
        for s in range(0, len(a), 1 << 13):
            part = slice(s, s + (1 << 13))
            bound = np.minimum(self.coarse[a[part]], self.coarse[b[part]]).sum(1, dtype=np.int64)
            out[part] &= rule.enough(bound, self.sizes[a[part]], self.sizes[b[part]])
        both = np.flatnonzero(out & (self.fine_row[a] >= 0) & (self.fine_row[b] >= 0))
        for s in range(0, len(both), 1 << 11):
            k = both[s : s + (1 << 11)]
            bound = np.minimum(self.fine[self.fine_row[a[k]]], self.fine[self.fine_row[b[k]]]).sum(1, dtype=np.int64)
            out[k] = rule.enough(bound, self.sizes[a[k]], self.sizes[b[k]])
        return out


class CountTree:
    """A packed R-tree over count vectors: per node the largest count of each group, the range of set sizes, and the range of blocks.

    Points of different blocks are never paired; they share a tree so that many small blocks are searched at once.
    """

    def __init__(self, counts: np.ndarray, sizes: np.ndarray, block: np.ndarray | None = None, fan: int = 16):
        block = np.zeros(len(sizes), np.int64) if block is None else block
        order = np.lexsort((*counts[:, :4].T, sizes, block)) if len(sizes) else np.zeros(0, int)
        self.order, self.fan, self.levels = order, fan, []
        node = [counts[order], sizes[order], sizes[order], block[order], block[order]]
        self.levels.append(node)
        while len(node[0]) > 1:
            heads = np.arange(0, len(node[0]), fan)
            node = [f.reduceat(x, heads) for f, x in zip((np.maximum, np.minimum, np.maximum, np.minimum, np.maximum), node)]
            self.levels.append(node)

    def search(self, counts: np.ndarray, sizes: np.ndarray, rule: Similarity, block: np.ndarray | None = None, most: int = 1 << 14) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Pairs (query, point) whose bound allows a link, a bounded number of open boxes at a time."""
        block = np.zeros(len(sizes), np.int64) if block is None else block
        work = [(len(self.levels) - 1, np.arange(len(sizes)), np.zeros(len(sizes), np.int64))] if len(self.order) else []
        while work:
            level, query, node = work.pop()
            if len(query) > most:
                half = len(query) // 2
                work += [(level, query[half:], node[half:]), (level, query[:half], node[:half])]
                continue
            top, least, largest, first, last = self.levels[level]
            # by block and size first, as they cost little
            ok = (first[node] <= block[query]) & (last[node] >= block[query])
            ok &= (rule.above * largest[node] >= rule.below * sizes[query]) & (rule.above * sizes[query] >= rule.below * least[node])
            query, node = query[ok], node[ok]
            # with b the least size in the box: (above + below) * i >= below * (a + b)
            ok = rule.enough(np.minimum(counts[query], top[node]).sum(1, dtype=np.int64), sizes[query], least[node])
            query, node = query[ok], node[ok]
            if level == 0:
                yield query, self.order[node]
            elif len(query):
                child = (node[:, None] * self.fan + np.arange(self.fan)).ravel()
                query = np.repeat(query, self.fan)
                there = child < len(self.levels[level - 1][1])
                work.append((level - 1, query[there], child[there]))


class Forest:
    """Which nodes are connected so far."""

    def __init__(self, nodes: int):
        self.root = np.arange(nodes)

    def find(self, k: int) -> int:
        while self.root[k] != k:
            self.root[k] = self.root[self.root[k]]
            k = self.root[k]
        return int(k)

    def unite(self, i: int, j: int) -> None:
        a, b = self.find(i), self.find(j)
        self.root[max(a, b)] = min(a, b)

    def roots(self) -> np.ndarray:
        while (self.root[self.root] != self.root).any():
            self.root = self.root[self.root]
        return self.root


def _number(*columns: np.ndarray) -> np.ndarray:
    """Equal rows of the columns get equal numbers from 0, in their order."""
    order = np.lexsort(columns[::-1])
    new = np.zeros(len(order), np.int64)
    if len(order):
        new[1:] = np.any([c[order][1:] != c[order][:-1] for c in columns], axis=0)
    out = np.empty(len(order), np.int64)
    out[order] = np.cumsum(new)
    return out


def _outside_main(block: np.ndarray, label: np.ndarray) -> np.ndarray:
    """Rows that haven't their block's most frequent label: a pair of unlike labels has at least one of them."""
    if not len(block):
        return np.zeros(0, np.int64)
    both = _number(block, label)
    often = np.bincount(both)
    order = np.argsort(often[both], kind="stable")
    main = np.zeros(block.max() + 1, np.int64)
    main[block[order]] = both[order]
    return np.flatnonzero(both != main[block])


def near_pairs(points: Points, block: np.ndarray, label: np.ndarray, side: np.ndarray, rule: Similarity) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of rows of one block with different labels whose bounds allow a link. side: rows of side 0 and 1 meet the other side only, those of 2 all."""
    asked = _outside_main(block, label)
    if not len(asked):
        return
    tree = CountTree(points.coarse, points.sizes, block)
    for a, b in tree.search(points.coarse[asked], points.sizes[asked], rule, block[asked]):
        a = asked[a]
        ok = (label[a] != label[b]) & ((side[a] != side[b]) | (side[a] == 2))
        a, b = a[ok], b[ok]
        ok = points.may_link(a, b, rule)
        if ok.any():
            yield a[ok], b[ok]


def candidate_forest(points: Points, block: np.ndarray, ids: np.ndarray, label: np.ndarray, side: np.ndarray, rule: Similarity) -> list[tuple[int, int]]:
    """Edges that connect the ends of every surviving pair (ids by row)."""
    known, node = np.unique(ids, return_inverse=True)
    forest, found = Forest(len(known)), []
    for a, b in near_pairs(points, block, label, side, rule):
        root = forest.roots()
        x, y = root[node[a]], root[node[b]]
        apart = np.unique(np.sort(np.stack([x, y])[:, x != y], axis=0), axis=1)
        for i, j in apart.T.tolist():
            if forest.find(i) != forest.find(j):
                forest.unite(i, j)
                found.append((int(known[i]), int(known[j])))
    return found


def verified_forest(offsets: np.ndarray, grams: np.ndarray, block: np.ndarray, seed: np.ndarray, side: np.ndarray, rule: Similarity) -> tuple[Forest, list[tuple[int, int]]]:
    """Links (rows) that with the seeds connect all linked sets of each block, and the forest. offsets: of each set in grams; sets of one seed are connected.

    Sorted neighbours are tried first; what they leave outside a block's largest group is searched for in the R-tree.
    """
    sizes = np.diff(offsets)
    node = _number(seed)
    forest, found = Forest(int(node.max(initial=-1)) + 1), []

    def verify(i: int, j: int) -> None:
        if forest.find(node[i]) != forest.find(node[j]):
            same = len(np.intersect1d(grams[offsets[i] : offsets[i + 1]], grams[offsets[j] : offsets[j + 1]], assume_unique=True))
            if rule.enough(same, sizes[i], sizes[j]):
                forest.unite(int(node[i]), int(node[j]))
                found.append((i, j))

    points = Points.of_sets(np.repeat(np.arange(len(sizes)), sizes), grams, sizes)
    order = np.lexsort((seed, sizes, block))
    a, b = order[:-1], order[1:]
    ok = (block[a] == block[b]) & ((side[a] != side[b]) | (side[a] == 2))
    a, b = a[ok], b[ok]
    ok = points.may_link(a, b, rule)
    for i, j in zip(a[ok].tolist(), b[ok].tolist()):
        verify(i, j)
    for a, b in near_pairs(points, block, forest.roots()[node].copy(), side, rule):
        root = forest.roots()
        ok = root[node[a]] != root[node[b]]
        for i, j in zip(a[ok].tolist(), b[ok].tolist()):
            verify(i, j)
    return forest, found


def common_grams(docs: DataFrame, rule: Similarity, sample: int = 20_000, least: int = 4, most: int = 100_000) -> np.ndarray:
    """Hashes of n-grams that several texts of a bounded sample share, sorted: a hint for the order of prefixes that no result depends on."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = byte_column(batch.column(0))
            for start, stop in slices(texts, 1 << 20):
                yield pa.RecordBatch.from_arrays([pa.array(shingles(texts.slice(start, stop - start), rule.words)[1].view(np.int64))], names=["gram"])

    rows = max(1, docs.count())
    chosen = min(sample, max(1000, rows // 20))
    drawn = docs.where(F.pmod(F.xxhash64("doc_id", F.lit(3)), F.lit(1_000_000)) < int(1_000_000 * min(1.0, chosen / rows)) + 1)
    grams = drawn.select("text").mapInArrow(run, "gram bigint").groupBy("gram").count().where(F.col("count") >= least)
    found = grams.orderBy(F.desc("count"), "gram").limit(most).select("gram").toPandas()["gram"].to_numpy(np.int64)
    return np.sort(found.view(np.uint64))


def _lists(owner: np.ndarray, values: np.ndarray, rows: int) -> pa.Array:
    ends = np.r_[0, np.cumsum(np.bincount(owner, minlength=rows))].astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(values.view(np.int64)))


def _column(table: pa.Table, name: str) -> np.ndarray:
    return table.column(name).to_numpy()


def _of(df: DataFrame, id_col: str, points: DataFrame, tag: str) -> DataFrame:
    """df with the size and count vector of the set whose id is in id_col, as n<tag> and c<tag>."""
    own = points.select(F.col("rep").alias(f"_{tag}"), F.col("n_shingles").alias(f"n{tag}"), F.col("counts").alias(f"c{tag}"))
    return df.join(own, F.col(id_col) == F.col(f"_{tag}")).drop(f"_{tag}")


def _neighbours(rows: DataFrame, rule: Similarity, reach: int) -> DataFrame:
    """Edges (u, v) between rows (g, n_shingles, rep) and the `reach` before them that have the same g, in the order of all three. No g is gathered in a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = [np.zeros(0, np.int64)] * 3
        for batch in batches:
            g, n, rep = (np.concatenate([x, c.to_numpy()]) for x, c in zip(last, batch.columns))
            u, v = [], []
            for d in range(1, reach + 1):
                ok = (g[d:] == g[:-d]) & (rep[d:] != rep[:-d]) & rule.sizes_fit(n[d:], n[:-d])
                u.append(rep[d:][ok])
                v.append(rep[:-d][ok])
            u, v = np.concatenate(u), np.concatenate(v)
            last = [x[-reach:] for x in (g, n, rep)]
            yield pa.RecordBatch.from_arrays([pa.array(np.minimum(u, v)), pa.array(np.maximum(u, v))], names=["u", "v"])

    dealt = rows.repartitionByRange("g", "n_shingles", "rep").sortWithinPartitions("g", "n_shingles", "rep")
    return dealt.select("g", "n_shingles", "rep").mapInArrow(run, "u bigint, v bigint").distinct()


def _with_grams(docs: DataFrame, placed: DataFrame, rule: Similarity, most: int = 8_000_000) -> DataFrame:
    """placed (rep and more) with the n-grams of the text of doc_id = rep; without the other texts moving, if at most `most` ids (about 30 bytes each) are broadcast."""
    more = [c for c in placed.columns if c != "rep"]
    ids = placed.select("rep").distinct()
    if ids.count() <= most:
        docs = docs.join(F.broadcast(ids.withColumnRenamed("rep", "_rep")), F.col("doc_id") == F.col("_rep"), "left_semi")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = byte_column(batch.column(0))
            for start, stop in slices(texts, 1 << 20):
                owner, grams = shingles(texts.slice(start, stop - start), rule.words)
                own = batch.slice(start, stop - start)
                yield pa.RecordBatch.from_arrays([*own.columns[1:], _lists(owner, grams, stop - start)], names=["rep", *more, "grams"])

    kinds = "".join(f", `{c}` {placed.schema[c].dataType.simpleString()}" for c in more)
    return docs.join(placed, F.col("doc_id") == F.col("rep")).select("text", "rep", *more).mapInArrow(run, f"rep bigint{kinds}, grams array<bigint>")


def _sized(clusters: DataFrame, single: DataFrame, block: int, block_grams: int) -> DataFrame:
    """(rep, component, subs, sub): clusters are cut into sub-blocks of about `block` sets and block_grams n-grams at most."""
    member = clusters.join(single.select("rep", "n_shingles"), F.col("node") == F.col("rep"))
    size = member.groupBy(F.col("component").alias("k")).agg(F.ceil(F.greatest(F.count("*") / block, F.sum("n_shingles") / block_grams)).alias("subs"))
    return member.join(size, F.col("component") == F.col("k")).select("rep", "component", "subs", F.pmod(F.xxhash64("rep"), F.col("subs")).alias("sub"), "n_shingles")


def _dealt(subs: Column, own: Column, shared: Column) -> Column:
    """Cut blocks have a group of their own, the small ones share."""
    return F.when(subs > 1, own).otherwise(shared)


def _grams(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    sizes = pc.list_value_length(table.column("grams")).to_numpy()
    return np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64), pc.list_flatten(table.column("grams")).to_numpy().view(np.uint64)


def jaccard_components(docs: DataFrame, rule: Similarity, block: int = 2000, text: str = "text", id_col: str = "doc_id", block_grams: int = 400_000) -> DataFrame:
    """Per row of docs: its id, n_shingles and component_id, the smallest id that links lead to (its own included).

    No link is lost: prefixes miss no linked pair, and blocks beyond `block` sets or block_grams n-grams are compared in pairs of
    sub-blocks. Rows without words (null and empty texts too), and those with a null id, are linked with nothing; rows that repeat an
    id are one document of the links. Exact copies are compared once, as their smallest id. Texts of any length are one set. An
    empty table gives none. Other columns are left out.
    """
    docs = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text).alias("text"))
    common = common_grams(docs, rule)

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = byte_column(batch.column(1))
            for start, stop in slices(texts, 1 << 20):
                rows = stop - start
                owner, grams = shingles(texts.slice(start, rows), rule.words)
                n = np.bincount(owner, minlength=rows)
                heads = (np.cumsum(n) - n)[n > 0]
                prints = [np.zeros(rows, np.uint64) for _ in range(2)]
                for k, p in enumerate(prints):
                    p[n > 0] = _sums(mix64(grams + np.uint64(k * 7919 + 1)), heads)
                ahead, often = prefixes(owner, grams, n, rule, common)
                place = np.arange(len(owner)) - (np.cumsum(n) - n)[owner]
                lists = [_lists(owner[x], grams[x], rows) for x in (place < 4, ahead & ~often, ahead & often)]
                counts = Points.of_sets(owner, grams, n).packed()
                fields = [batch.column(0).slice(start, rows), pa.array(n.astype(np.int64)), *(pa.array(p.view(np.int64)) for p in prints), *lists, pa.array(counts, pa.binary())]
                yield pa.RecordBatch.from_arrays(fields, names=["doc_id", "n_shingles", "f1", "f2", "lead", "rare", "often", "counts"])

    sets = stage(docs.mapInArrow(describe, "doc_id bigint, n_shingles bigint, f1 bigint, f2 bigint, lead array<bigint>, rare array<bigint>, often array<bigint>, counts binary"), "sets")
    key = ["n_shingles", "f1", "f2"]
    known = sets.where("n_shingles > 0 AND doc_id IS NOT NULL")
    single = stage(known.groupBy(*key).agg(F.min("doc_id").alias("rep"), F.first("lead").alias("lead"), F.first("counts").alias("counts")), "distinct-sets")
    points = single.select("rep", "n_shingles", "counts")

    # first pass: labels of what a few hashes and sorted neighbours bring together
    def bounded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = np.concatenate([batch.column(c).to_numpy() for c in ("nu", "nv")])
            both = Points.unpacked(sizes, batch.column("cu").to_pylist() + batch.column("cv").to_pylist())
            at = np.arange(batch.num_rows)
            yield batch.select(["u", "v"]).filter(pa.array(both.may_link(at, at + batch.num_rows, rule)))

    near = _neighbours(single.select("rep", "n_shingles", F.explode("lead").alias("g")), rule, 2)
    close = _of(_of(near, "u", points, "u"), "v", points, "v").mapInArrow(bounded, "u bigint, v bigint")
    placed = stage(_sized(connected_components(close), single, block, block_grams), "first-blocks")
    # a cut cluster's smallest set is in each of its sub-blocks
    every = F.when(F.col("rep") == F.col("component"), F.sequence(F.lit(0).cast("bigint"), F.col("subs") - 1)).otherwise(F.array("sub"))
    calls = int((placed.agg(F.sum("n_shingles")).first()[0] or 0) // block_grams) + 1
    mine = F.xxhash64("component", "sub")
    tiles = _with_grams(docs, placed, rule).withColumn("sub", F.explode(every)).withColumn("call", _dealt(F.col("subs"), mine, F.pmod(mine, F.lit(calls))))

    def settle(table: pa.Table) -> pa.Table:
        rep, component = _column(table, "rep"), _column(table, "component")
        offsets, grams = _grams(table)
        at = _number(component, _column(table, "sub"))
        # ids are seeds: rows that repeat one are one document, but in different sub-blocks apart
        seed = _number(at, rep)
        forest, _ = verified_forest(offsets, grams, at, seed, np.full(len(rep), 2), rule)
        root = forest.roots()[seed]
        label = np.full(len(forest.root), np.iinfo(np.int64).max)
        np.minimum.at(label, root, rep)
        return pa.table({"rep": rep, "label": label[root]})

    labels = tiles.groupBy("call", "subs").applyInArrow(settle, "rep bigint, label bigint").groupBy(F.col("rep").alias("of")).agg(F.min("label").alias("label"))
    marks = stage(single.join(labels, F.col("rep") == F.col("of"), "left").select(*key, "rep", F.coalesce("label", "rep").alias("label")), "labels")

    # second pass: whole prefixes, in buckets that hold several labels
    renamed = marks.select(*[F.col(c).alias(f"m_{c}") for c in key], "rep", "label")
    own = [F.col(c) == F.col(f"m_{c}") for c in key] + [F.col("doc_id") == F.col("rep")]
    rows = lambda c: known.select("doc_id", *key, c).join(renamed, own).select(F.explode(c).alias("g"), "rep", "label", "n_shingles")
    several, by_size = Window.partitionBy("g"), Window.partitionBy("g").orderBy("n_shingles", "rep")
    # a rare n-gram's bucket is small by the sample; those of common ones are counted before anything is gathered. Who has a partner
    # of fitting size in the bucket has a neighbour of fitting size
    beside = [f(F.col("n_shingles")).over(by_size).alias(c) for f, c in ((F.lag, "before"), (F.lead, "after"))]
    rare = rows("rare").select("*", F.min("label").over(several).alias("lo"), F.max("label").over(several).alias("hi"), F.count("*").over(several).alias("many"), *beside).where("lo < hi")
    rare = rare.where((rule.above * F.col("before") >= rule.below * F.col("n_shingles")) | (rule.above * F.col("n_shingles") >= rule.below * F.col("after")))
    mixed = rows("often").groupBy(F.col("g").alias("k")).agg(F.min("label").alias("lo"), F.max("label").alias("hi"), F.count("*").alias("many")).where("lo < hi")
    often = rows("often").join(mixed, F.col("g") == F.col("k"))
    fields = ["g", "rep", "label", F.ceil(F.col("many") / block).alias("subs")]
    met = stage(rare.select(*fields).unionByName(often.select(*fields)), "met")
    calls2 = met.count() // 5_000 + 1
    pairs = F.transform(F.sequence(F.lit(0).cast("bigint"), F.col("subs") - 1), lambda x: F.struct(F.least("sub", x).alias("a"), F.greatest("sub", x).alias("b")))

    def paired(df: DataFrame, key: Column, calls: int) -> DataFrame:
        tile = df.withColumn("tile", F.explode(pairs)).select(*df.columns, "tile.a", "tile.b")
        return tile.withColumn("call", _dealt(F.col("subs"), F.xxhash64(key, "a", "b"), F.pmod(F.xxhash64(key), F.lit(calls))))

    def sides(table: pa.Table) -> np.ndarray:
        a, b, sub = (_column(table, c) for c in ("a", "b", "sub"))
        return np.where(a == b, 2, (sub == b).astype(np.int64))

    def compare(table: pa.Table) -> pa.Table:
        both = Points.unpacked(_column(table, "n"), table.column("c").to_pylist())
        found = candidate_forest(both, _number(_column(table, "g"), _column(table, "a"), _column(table, "b")), _column(table, "rep"), _column(table, "label"), sides(table), rule)
        return pa.table({"u": pa.array([i for i, _ in found], pa.int64()), "v": pa.array([j for _, j in found], pa.int64())})

    buckets = paired(_of(met.withColumn("sub", F.pmod(F.xxhash64("rep"), F.col("subs"))), "rep", points, ""), F.col("g"), calls2)
    candidates = buckets.groupBy("call", "subs").applyInArrow(compare, "u bigint, v bigint")
    placed2 = _sized(connected_components(candidates), single, block, block_grams)
    placed2 = stage(placed2.join(marks.select(F.col("rep").alias("of"), "label"), F.col("rep") == F.col("of")).drop("of"), "second-blocks")
    calls3 = int((placed2.agg(F.sum("n_shingles")).first()[0] or 0) // block_grams) + 1

    def verify(table: pa.Table) -> pa.Table:
        offsets, grams = _grams(table)
        label = _column(table, "label")
        _, found = verified_forest(offsets, grams, _number(*(_column(table, c) for c in ("component", "a", "b"))), label, sides(table), rule)
        return pa.table({"u": label[[i for i, _ in found]].astype(np.int64), "v": label[[j for _, j in found]].astype(np.int64)})

    links = paired(_with_grams(docs, placed2, rule), F.col("component"), calls3).groupBy("call", "subs").applyInArrow(verify, "u bigint, v bigint")

    # labels are joined by these links, and by ids that have several sets
    whose = known.select("doc_id", *key).join(renamed.drop("rep"), own[:-1]).select("doc_id", "label")
    least = whose.groupBy(F.col("doc_id").alias("k")).agg(F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo < hi")
    again = whose.join(least, F.col("doc_id") == F.col("k")).select(F.col("label").alias("u"), F.col("lo").alias("v"))
    reached = connected_components(links.unionByName(again))
    final = marks.join(reached, F.col("label") == F.col("node"), "left").select(*[F.col(c).alias(f"m_{c}") for c in key], F.coalesce("component", "label").alias("component"))
    back = sets.select("doc_id", *key).join(final, own[:-1], "left")
    return back.select(F.col("doc_id").alias(id_col), "n_shingles", F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id")).alias("component_id"))
