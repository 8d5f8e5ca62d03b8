"""Nearest neighbours by a hierarchical k-means tree.

The tree is fitted on a bounded sample of SAMPLE vectors; every vector is indexed under the leaf that it descends to. A
query walks the tree best bin first: a priority queue holds the branches seen so far by their centre's inner product
with it, so the leaves come in the order of their promise. How many of them a query visits is calibrated: CALIBRATED
queries are answered by brute force over all vectors, and visits widen until the mean recall reaches the target with a
margin for the error of that mean.

Visits widen in rounds of double the leaves. What a query has found so far bounds what later leaves need to report, so a
round reports about as many candidates as neighbours are wanted, however many leaves it visits.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandwork.llm.common import drop, written
from strandwork.llm.vectors import common_dim, dtype_of, matrix, sample, unpacked, usable

#: Vectors that the tree is fitted on; vectors in a leaf, about; children of a node; k-means rounds.
SAMPLE, LEAF, BRANCHES, KMEANS_ROUNDS = 20_000, 512, 8, 8
#: Queries that calibrate; recall aimed at; vectors of a leaf that one task searches, about.
CALIBRATED, RECALL, TILE = 200, 0.95, 4096


class Tree:
    """centres of all nodes; children by node, none for a leaf; leaves numbered in order."""

    def __init__(self, points: np.ndarray, leaves: int, seed: int = 11):
        self.rng = np.random.default_rng(seed)
        self.centres: list[np.ndarray] = []
        self.children: list[list[int]] = []
        self.leaf: dict[int, int] = {}
        self._grow(points, leaves)
        self.centre = np.array(self.centres)
        self.nodes = list(self.leaf)

    def _grow(self, points: np.ndarray, leaves: int) -> int:
        node = len(self.centres)
        self.centres.append(points.mean(axis=0))
        self.children.append([])
        k = min(BRANCHES, leaves, len(points))
        if k > 1:
            centres = points[self.rng.choice(len(points), k, replace=False)]
            for _ in range(KMEANS_ROUNDS):
                near = self._nearest(points, centres)
                centres = np.stack([points[near == c].mean(axis=0) if (near == c).any() else centres[c] for c in range(k)])
            near = self._nearest(points, centres)
            groups = [points[near == c] for c in range(k) if (near == c).any()]
            if len(groups) > 1:
                for own in groups:
                    self.children[node].append(self._grow(own, max(1, round(leaves * len(own) / len(points)))))
                return node
        self.leaf[node] = len(self.leaf)
        return node

    @staticmethod
    def _nearest(points: np.ndarray, centres: np.ndarray) -> np.ndarray:
        return (points @ centres.T - (centres**2).sum(axis=1) / 2).argmax(axis=1)

    def descend(self, points: np.ndarray) -> np.ndarray:
        """The leaf of each point."""
        out = np.zeros(len(points), np.int64)
        held = [(0, np.arange(len(points)))]
        while held:
            node, rows = held.pop()
            if not self.children[node]:
                out[rows] = self.leaf[node]
            elif len(rows):
                near = self._nearest(points[rows], self.centre[self.children[node]])
                held += [(child, rows[near == c]) for c, child in enumerate(self.children[node])]
        return out

    def visits(self, query: np.ndarray, n: int) -> list[int]:
        """The first n leaves, best bin first."""
        promise = self.centre @ query
        queue, out = [(-promise[0], 0)], []
        while queue and len(out) < n:
            _, node = heapq.heappop(queue)
            while self.children[node]:  # down to a leaf by the best child; the others wait
                first, *rest = sorted(self.children[node], key=lambda c: -promise[c])
                for c in rest:
                    heapq.heappush(queue, (-promise[c], c))
                node = first
            out.append(self.leaf[node])
        return out


def _indexer(tree: Tree, dim: int, dtype: np.dtype, tiles: dict[int, int] | None = None):
    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = matrix(batch.column(1), dim)
            columns = [batch.column(0), pa.array(tree.descend(x)), pa.array([v.tobytes() for v in x.astype(dtype)], pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names=["vec_id", "leaf", "vector"])

    return index


def _brute(queries: np.ndarray, ids: np.ndarray, k: int, dim: int):
    """For each query the k best of a task's rows."""

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best_s, best_i = np.zeros((len(queries), 0)), np.zeros((len(queries), 0), np.int64)
        for batch in batches:
            x, own = matrix(batch.column(1), dim), batch.column(0).to_numpy()
            for at in range(0, len(x), 4096):
                s = queries @ x[at : at + 4096].T
                i = np.broadcast_to(own[at : at + 4096], s.shape)
                s = np.where(i == ids[:, None], -np.inf, s)
                best_s, best_i = np.concatenate([best_s, s], axis=1), np.concatenate([best_i, i], axis=1)
                if best_s.shape[1] > k:
                    top = np.argpartition(-best_s, k - 1, axis=1)[:, :k]
                    best_s, best_i = np.take_along_axis(best_s, top, 1), np.take_along_axis(best_i, top, 1)
        q = np.repeat(np.arange(len(queries)), best_s.shape[1])
        yield pa.RecordBatch.from_arrays([pa.array(q), pa.array(best_i.reshape(-1)), pa.array(best_s.reshape(-1))], names=["q", "vec_id", "score"])

    return search


def calibrate(tree: Tree, rows: DataFrame, asked: DataFrame, k: int, dim: int, recall: float) -> int:
    """How many leaves to visit."""
    drawn = asked.select("vec_id", "vector", F.xxhash64("vec_id").alias("h")).orderBy("h", "vec_id").limit(CALIBRATED).collect()
    queries, ids = np.array([r["vector"] for r in drawn], np.float64), np.array([r["vec_id"] for r in drawn], np.int64)
    found = rows.select("vec_id", "vector").mapInArrow(_brute(queries, ids, k, dim), "q long, vec_id long, score double")
    best = found.where("score > double('-inf')").groupBy("q").agg(F.slice(F.sort_array(F.collect_list(F.struct((-F.col("score")).alias("s"), "vec_id"))), 1, k).alias("top"))
    want = best.select("q", F.explode("top.vec_id").alias("vec_id"))
    at = want.join(rows.select("vec_id", "vector"), "vec_id").select("q", "vector").collect()  # CALIBRATED * k vectors at most
    leaf = tree.descend(np.array([r["vector"] for r in at], np.float64)) if at else np.zeros(0, np.int64)
    total = np.bincount([r["q"] for r in at], minlength=len(queries)) if at else np.ones(len(queries))
    orders = [tree.visits(q, len(tree.leaf)) for q in queries]
    place = [{x: n for n, x in enumerate(order)} for order in orders]
    rank = np.array([place[r["q"]][x] for r, x in zip(at, leaf)])
    q_of = np.array([r["q"] for r in at], np.int64)
    visits = 1
    while visits < len(tree.leaf):
        hit = np.bincount(q_of[rank < visits], minlength=len(queries)) / np.maximum(total, 1)
        if hit.mean() - 2 * hit.std() / math.sqrt(max(len(hit), 1)) >= recall:
            break
        visits = min(len(tree.leaf), max(visits + 1, math.ceil(visits * 1.1)))
    return visits


def _visitor(tree: Tree, first: int, last: int, dtype: np.dtype):
    def visit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = unpacked(pa.chunked_array([batch.column(1)]), dtype)
            leaves = [tree.visits(q, last)[first:] for q in x]
            at = np.repeat(np.arange(len(x)), [len(own) for own in leaves])
            columns = [batch.column(0).take(pa.array(at)), batch.column(1).take(pa.array(at)), batch.column(2).take(pa.array(at)), pa.array(np.concatenate([*leaves, []]).astype(np.int64))]
            yield pa.RecordBatch.from_arrays(columns, names=["query_id", "query", "bound", "leaf"])

    return visit


def _searcher(k: int, dtype: np.dtype):
    def search(key: tuple, asked: pa.Table, held: pa.Table) -> pa.Table:
        out_q, out_i, out_s = [], [], []
        if len(asked) and len(held):
            x, ids = unpacked(held["vector"], dtype), held["vec_id"].to_numpy()
            order = np.argsort(ids, kind="stable")
            x, ids = x[order], ids[order]
            for begin in range(0, len(asked), 1024):
                part = asked.slice(begin, 1024)
                q = part["query_id"].to_numpy()
                s = unpacked(part["query"], dtype) @ x.T
                s[q[:, None] == ids[None, :]] = -np.inf
                bound = part["bound"].to_numpy()
                rows, cols = np.nonzero((s >= bound[:, None]) & (s > -np.inf))
                best = np.lexsort((ids[cols], -s[rows, cols], rows))
                rows, cols = rows[best], cols[best]
                nth = np.arange(len(rows)) - np.searchsorted(rows, rows)
                rows, cols = rows[nth < k], cols[nth < k]
                out_q.append(q[rows])
                out_i.append(ids[cols])
                out_s.append(s[rows, cols])
        empty = [np.zeros(0, np.int64)]
        return pa.table({"query_id": np.concatenate(out_q or empty), "vec_id": np.concatenate(out_i or empty), "score": np.concatenate(out_s or [np.zeros(0)])})

    return search


def search(table: DataFrame, asked: Column, k: int = 20, recall: float = RECALL, vec_id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): for each row of table that `asked` holds for, the k other rows with the largest
    inner product that the search finds, nearest first, ties to the smaller id.

    asked: a condition on table. Vectors that are null, zero, hold null or non-finite components or aren't of the most
    frequent dimension take no part, nor do rows with a null id. Repeated rows of one id count once, by the smallest of their vectors. With k rows or
    fewer all are found. Other columns don't matter.
    """
    spark = table.sparkSession
    rows = table.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(vector).alias("vector"), F.coalesce(asked, F.lit(False)).alias("asked"))
    rows = rows.where(usable("vector") & F.col("vec_id").isNotNull()).groupBy("vec_id").agg(F.min("vector").alias("vector"), F.max("asked").alias("asked"))
    rows, rows_path = written(rows)
    dim, dtype = common_dim(rows, "vector"), dtype_of(rows, "vector")
    rows = rows.where(F.size("vector") == dim)
    n = rows.count()
    if not n or rows.where("asked").isEmpty():
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    points = sample(rows, "vector", "vec_id", SAMPLE)
    tree = Tree(points, max(1, min(n // LEAF, len(points) // 8)))
    last = calibrate(tree, rows, rows.where("asked"), k, dim, recall)
    indexed, index_path = written(rows.select("vec_id", "vector").mapInArrow(_indexer(tree, dim, dtype), "vec_id long, leaf long, vector binary"))
    sizes = indexed.groupBy("leaf").count().collect()  # one row a leaf: at most SAMPLE / 8
    tiles = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for r in sizes for x in (r["leaf"], -(-r["count"] // TILE))]), F.col("leaf")), F.lit(1))
    indexed = indexed.withColumn("tile", F.pmod(F.xxhash64("vec_id"), tiles))
    top, top_path, begin, step = None, None, 0, 2
    queries = indexed.join(rows.where("asked").select("vec_id"), "vec_id", "left_semi").select(F.col("vec_id").alias("query_id"), F.col("vector").alias("query"))
    while begin < last:
        end = min(begin + step, last)
        if top is None:
            bounded = queries.withColumn("bound", F.lit(float("-inf")))
        else:
            bound = F.when(F.size("top") >= k, -F.element_at("top", k)["s"]).otherwise(float("-inf"))
            bounded = queries.join(top, "query_id", "left").select("query_id", "query", F.coalesce(bound, F.lit(float("-inf"))).alias("bound"))
        visits = bounded.mapInArrow(_visitor(tree, begin, end, dtype), "query_id long, query binary, bound double, leaf long")
        visits = visits.withColumn("tile", F.explode(F.sequence(F.lit(0), (tiles - 1).cast("long"))))
        found = visits.groupBy("leaf", "tile").cogroup(indexed.groupBy("leaf", "tile")).applyInArrow(_searcher(k, dtype), "query_id long, vec_id long, score double")
        found = found.select("query_id", F.struct((-F.col("score")).alias("s"), "vec_id").alias("hit"))
        if top is not None:
            found = found.union(top.select("query_id", F.explode("top").alias("hit")))
        merged, path = written(found.groupBy("query_id").agg(F.slice(F.sort_array(F.collect_list("hit")), 1, k).alias("top")))
        if top_path:
            drop(spark, top_path)
        top, top_path, begin, step = merged, path, end, step * 2
    ranked = top.select("query_id", F.posexplode("top").alias("rank", "hit"))
    return ranked.select("query_id", (F.col("rank") + 1).cast("int").alias("rank"), F.col("hit.vec_id").alias("vec_id"), (-F.col("hit.s")).alias("score"))
