"""Approximate nearest neighbours by adaptive dimension scan.

Vectors are lifted by one coordinate to equal length, so that the largest inner product is the least distance, and
rotated at random; then the leading coordinates of any difference estimate its whole length. Lists of an inverted file
are scanned in blocks of columns: after each block a hypothesis test on the partial distance abandons candidates that
are unlikely to beat the query's present k-th best, and the rest goes on. Scores are taken on the original vectors.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import stage


@dataclass
class Index:
    """What a bounded sample gives: rotation, centroids of the lists, and how many lists a query visits."""

    rotation: np.ndarray
    centroids: np.ndarray  # rotated
    probes: int
    longest: float
    slack: float = 2.1
    column_block: int = 16

    def lift(self, vectors: np.ndarray) -> np.ndarray:
        rest = np.sqrt(np.maximum(self.longest**2 - (vectors**2).sum(1), 0))
        return np.column_stack([vectors, rest]) @ self.rotation

    def lift_query(self, vectors: np.ndarray) -> np.ndarray:
        return np.column_stack([vectors, np.zeros(len(vectors))]) @ self.rotation

    def nearest_lists(self, lifted: np.ndarray, count: int) -> np.ndarray:
        apart = (self.centroids**2).sum(1) - 2 * lifted @ self.centroids.T
        return np.argsort(apart, axis=1, kind="stable")[:, :count]


def usable(vectors: DataFrame, id_col: str, vector: str) -> DataFrame:
    """Rows with an id and a vector that isn't empty, zero, or with null or non-finite components; components as doubles."""
    values = F.col(vector).cast("array<double>")
    finite = F.forall(values, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < math.inf))
    return vectors.select(F.col(id_col).cast("bigint").alias("vec_id"), values.alias("v")).where(F.col("vec_id").isNotNull() & F.col("v").isNotNull() & finite & F.exists("v", lambda x: x != 0))


def fit_index(rows: DataFrame, k: int, sample_rows: int = 20_000, most_lists: int = 4096, recall: float = 0.96, seed: int = 7) -> Index:
    """From about sample_rows hashed rows: sqrt(rows) lists (most_lists at most), and the least number of lists to visit at which the sample's own neighbours are found with that recall.

    Every row is assigned to a list later; only the sample reaches the driver.
    """
    size = rows.agg(F.count("*").alias("n"), F.max(F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x))).alias("longest"), F.max(F.size("v")).alias("width"), F.min(F.size("v")).alias("least")).first()
    n, width = size["n"], size["width"] or 1
    if n and size["least"] != width:
        raise ValueError("vectors have different lengths")
    chosen = rows.where(F.pmod(F.xxhash64("vec_id", F.lit(17)), F.lit(1_000_000)) < int(1_000_000 * min(1.0, sample_rows / max(1, n))) + 1)
    sample = chosen.toPandas().sort_values("vec_id", kind="stable")
    rng = np.random.default_rng(seed)
    rotation = np.linalg.qr(rng.standard_normal((width + 1, width + 1)))[0]
    index = Index(rotation, np.zeros((1, width + 1)), 1, size["longest"] or 0.0)
    if not len(sample):
        return index
    points = np.stack(sample["v"].to_numpy()).astype(float)
    lifted = index.lift(points)
    lists = max(1, min(most_lists, round(math.sqrt(n)), len(sample)))
    centroids = lifted[rng.choice(len(lifted), lists, replace=False)]
    for _ in range(8):
        own = ((centroids**2).sum(1) - 2 * lifted @ centroids.T).argmin(1)
        count = np.bincount(own, minlength=lists)
        sums = np.zeros_like(centroids)
        np.add.at(sums, own, lifted)
        centroids = np.where(count[:, None] > 0, sums / np.maximum(count, 1)[:, None], centroids)
    index.centroids = centroids
    own = ((centroids**2).sum(1) - 2 * lifted @ centroids.T).argmin(1)
    asked = rng.choice(len(points), min(256, len(points)), replace=False)
    near = points[asked] @ points.T
    near[np.arange(len(asked)), asked] = -np.inf
    best = np.argsort(-near, axis=1, kind="stable")[:, : min(k, len(points) - 1)]
    rank = np.argsort(index.nearest_lists(index.lift_query(points[asked]), lists), axis=1)
    needed = np.sort(rank[np.arange(len(asked))[:, None], own[best]].ravel())
    index.probes = int(needed[min(len(needed) - 1, math.ceil(recall * len(needed)))]) + 1 if len(needed) else lists
    return index


def _matrix(column: pa.ChunkedArray, width: int) -> np.ndarray:
    return pc.list_flatten(column).to_numpy().astype(float).reshape(-1, width)


def survivors(index: Index, asked: np.ndarray, lifted: np.ndarray, limit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (query, row) that the tests on partial distances don't abandon; limit: each query's squared distance to beat.

    The first column blocks are matrix products for all pairs; once few are left they are followed as a list.
    """
    width, pairs = lifted.shape[1], None
    partial, alive = np.zeros((len(asked), len(lifted))), np.ones((len(asked), len(lifted)), bool)
    for start in range(0, width - index.column_block, index.column_block):
        seen = start + index.column_block
        # abandon if the scaled partial distance passes the limit by more than chance allows
        most = limit * (1 + index.slack / math.sqrt(seen)) ** 2 * (seen / width)
        q, b = asked[:, start:seen], lifted[:, start:seen]
        if pairs is None:
            partial += (q**2).sum(1)[:, None] + (b**2).sum(1) - 2 * q @ b.T
            alive &= partial <= most[:, None]
            if alive.mean() < 0.1:
                pairs = np.nonzero(alive)
                partial = partial[pairs]
        else:
            partial += ((q[pairs[0]] - b[pairs[1]]) ** 2).sum(1)
            stay = partial <= most[pairs[0]]
            pairs, partial = (pairs[0][stay], pairs[1][stay]), partial[stay]
    return pairs if pairs is not None else np.nonzero(alive)


def scan(index: Index, queries: np.ndarray, least: np.ndarray, own: np.ndarray, ids: np.ndarray, original: np.ndarray, k: int, first: int = 512) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Query, id and score of the k best of a tile for each query, none below its `least` (-inf: no bound yet); own: each query's id."""
    asked, lifted = index.lift_query(queries), index.lift(original)
    reach, least = (queries**2).sum(1) + index.longest**2, least.copy()
    best_q, best_i, best_s = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
    start = 0
    while start < len(ids):
        open_ = np.isneginf(least)
        stop = min(len(ids), start + (first if open_.any() else 4096))
        hits = []
        if open_.any():
            # without a bound all are scored, and those about the k-th best kept
            score = queries[open_] @ original[start:stop].T
            score[own[open_][:, None] == ids[start:stop]] = -np.inf
            at = np.partition(score, -k, axis=1)[:, -k] if score.shape[1] > k else np.full(len(score), -np.inf)
            q, b = np.nonzero(score >= (at - 1e-9 * (1 + np.abs(at)))[:, None] if score.shape[1] > k else np.isfinite(score))
            hits.append((np.flatnonzero(open_)[q], b + start))
        if not open_.all():
            bound = np.flatnonzero(~open_)
            q, b = survivors(index, asked[bound], lifted[start:stop], reach[bound] - 2 * least[bound])
            hits.append((bound[q], b + start))
        q, b = (np.concatenate(x) for x in zip(*hits))
        ok = ids[b] != own[q]
        q, b = q[ok], b[ok]
        score = np.concatenate([(original[b[x : x + (1 << 16)]] * queries[q[x : x + (1 << 16)]]).sum(1) for x in range(0, len(q), 1 << 16)] or [np.zeros(0)])
        ok = score >= least[q]
        best_q, best_i, best_s = np.r_[best_q, q[ok]], np.r_[best_i, ids[b[ok]]], np.r_[best_s, score[ok]]
        order = np.lexsort((best_i, -best_s, best_q))
        best_q, best_i, best_s = best_q[order], best_i[order], best_s[order]
        rank = np.arange(len(best_q)) - np.searchsorted(best_q, best_q)
        kth = rank == k - 1
        least[best_q[kth]] = np.maximum(least[best_q[kth]], best_s[kth])
        best_q, best_i, best_s = (x[rank < k] for x in (best_q, best_i, best_s))
        start = stop
    return best_q, best_i, best_s


def _tiles(base: DataFrame, queries: DataFrame, base_rows: int, query_rows: int) -> tuple[DataFrame, DataFrame]:
    """Both sides dealt to tiles (list, base block, query block) of bounded size."""
    nb = base.groupBy("list").agg(F.ceil(F.count("*") / base_rows).alias("nb"))
    nq = queries.groupBy("list").agg(F.ceil(F.count("*") / query_rows).alias("nq"))
    plan = nb.join(nq, "list")
    to = lambda n: F.sequence(F.lit(0).cast("bigint"), F.col(n) - 1)
    b = base.join(plan, "list").withColumn("b", F.pmod(F.xxhash64("vec_id"), F.col("nb"))).withColumn("q", F.explode(to("nq")))
    q = queries.join(plan, "list").withColumn("q", F.pmod(F.xxhash64("query_id", F.lit(1)), F.col("nq"))).withColumn("b", F.explode(to("nb")))
    return b.select("list", "b", "q", "vec_id", "v"), q.select("list", "b", "q", "query_id", "qv", "least")


def search(vectors: DataFrame, is_query: str, k: int = 20, index: Index | None = None, base_rows: int = 4096, query_rows: int = 1024, id_col: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score) of each query's k nearest found, itself left out; ties go to the smaller vec_id.

    is_query: an SQL condition on vec_id. Unusable vectors (see usable) take no part; rows that repeat an id count once, with
    the least vector; ties of scores go to the smaller id. Queries that find fewer than k in their lists go on through all others, so fewer
    candidates than k give them all. An empty table gives none. First a query's nearest list is scanned; its
    k-th best score there then prunes the scan of the others from the start. Lists and their queries are cut into tiles,
    so neither a list that holds a third of all rows nor one that most queries visit meets in one task.
    """
    rows = usable(vectors, id_col, vector)
    rows = stage(rows.groupBy("vec_id").agg(F.min("v").alias("v")), "vectors")
    index = index or fit_index(rows, k)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                v = np.stack(batch.column(1).to_numpy(zero_copy_only=False)).astype(float)
                own = np.concatenate([index.nearest_lists(index.lift(v[s : s + 2048]), 1)[:, 0] for s in range(0, len(v), 2048)])
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(own)], names=["vec_id", "v", "list"])

    def visit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                v = np.stack(batch.column(1).to_numpy(zero_copy_only=False)).astype(float)
                lists = np.concatenate([index.nearest_lists(index.lift_query(v[s : s + 2048]), index.probes) for s in range(0, len(v), 2048)])
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(list(lists), pa.list_(pa.int64()))], names=["query_id", "qv", "lists"])

    base = stage(rows.mapInArrow(assign, "vec_id bigint, v array<double>, list bigint"), "lists")
    asked = stage(rows.where(is_query).mapInArrow(visit, "query_id bigint, qv array<double>, lists array<bigint>"), "queries")

    width = len(index.rotation) - 1

    def in_tile(base_part: pa.Table, query_part: pa.Table) -> pa.Table:
        base_part = base_part.sort_by("vec_id")
        own = query_part.column("query_id").to_numpy()
        q, i, s = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
        if len(base_part) and len(query_part):
            least = pc.fill_null(query_part.column("least"), -math.inf).to_numpy()
            q, i, s = scan(index, _matrix(query_part.column("qv"), width), least, own, base_part.column("vec_id").to_numpy(), _matrix(base_part.column("v"), width), k)
        return pa.table({"query_id": own[q], "vec_id": i, "score": s})

    def scanned(queries: DataFrame) -> DataFrame:
        b, q = _tiles(base, queries, base_rows, query_rows)
        keys = ("list", "b", "q")
        return b.groupBy(*keys).cogroup(q.groupBy(*keys)).applyInArrow(in_tile, "query_id bigint, vec_id bigint, score double")

    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    top = lambda df: df.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    home = asked.select("query_id", "qv", F.get("lists", F.lit(0)).alias("list"), F.lit(None).cast("double").alias("least"))
    near = stage(top(scanned(home)), "home")
    limit = near.where(F.col("rank") == k).select(F.col("query_id").alias("of"), F.col("score").alias("least"))
    rest = asked.join(limit, F.col("query_id") == F.col("of"), "left").select("query_id", "qv", F.explode(F.slice("lists", 2, index.probes)).alias("list"), "least")
    pairs = near.select("query_id", "vec_id", "score").unionByName(scanned(rest))
    if index.probes >= len(index.centroids):
        return top(pairs).select("query_id", "rank", "vec_id", "score")
    found = stage(top(pairs).select("query_id", "rank", "vec_id", "score"), "found")
    # who has fewer than k goes on through the lists that aren't visited yet
    full = found.where(F.col("rank") == k).select(F.col("query_id").alias("of"))
    short = stage(asked.join(full, F.col("query_id") == F.col("of"), "left_anti"), "short")
    if short.isEmpty():
        return found
    others = F.array_except(F.sequence(F.lit(0), F.lit(len(index.centroids) - 1)).cast("array<bigint>"), "lists")
    more = scanned(short.select("query_id", "qv", F.explode(others).alias("list"), F.lit(None).cast("double").alias("least")))
    return top(found.drop("rank").unionByName(more)).select("query_id", "rank", "vec_id", "score")
