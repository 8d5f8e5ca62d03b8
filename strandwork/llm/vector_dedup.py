"""Near-duplicate vectors by a forest of random-projection trees.

Each tree splits the sphere by random directions near the median; what lies close to a split goes both ways, so two
similar vectors part only if their projections differ by more than the overlap. Trees are fitted on a bounded sample of
SAMPLE vectors, and are as deep as the table needs: where the sample is used up, the levels below share a direction each,
cut at the median of the sample in the leaf above. Then every vector is sent down all of them. Vectors of one leaf and
label are compared in double precision. A pair that shares several leaves is counted by the first of them alone.

A leaf gives its members' numbers of links and a star over each group that links join, not the pairs, so what leaves it
grows with its members. Equal vectors are one node with a weight. A leaf over TILE vectors is cut into tiles that are
compared two by two, so no task holds more than two tiles whatever the leaf.

The numbers of links of PROBES vectors are counted by brute force, and the trees are doubled until they find RECALL of them.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandwork.llm.common import components, drop, written
from strandwork.llm.vectors import common_dim, dtype_of, matrix, sample, unpacked, usable

#: Trees to begin with and at most; vectors of a label in a leaf, about; vectors that the trees are fitted on; vectors in a
#: tile.
TREES, MOST_TREES, LEAF, SAMPLE, TILE = 8, 64, 256, 20_000, 2048
#: Vectors whose links are counted by brute force; share of these links that the trees have to find.
PROBES, RECALL = 500, 0.99
#: Overlap on either side of a split, in standard deviations of the difference of a pair at the threshold.
OVERLAP = 0.5


class Forest:
    """directions and cuts by tree, level order: node i has children 2i + 1 and 2i + 2. Below depth there are `deeper` more
    levels, with a direction a level and a cut a level and leaf."""

    def __init__(self, points: np.ndarray, trees: int, depth: int, overlap: float, deeper: int = 0, seed: int = 7):
        rng = np.random.default_rng(seed)
        dim = points.shape[1] if points.ndim == 2 else 1
        self.depth, self.overlap, self.deeper = depth, overlap, deeper
        nodes = 2**depth - 1
        self.directions = _directions(rng, trees, nodes, dim)
        self.low_directions = _directions(rng, trees, deeper, dim)
        self.cuts, self.low_cuts = np.zeros((trees, nodes)), np.zeros((trees, nodes + 1, deeper))
        for t in range(trees):
            held = {0: points}
            for node in range(nodes):
                own = held.pop(node, points[:0])
                p = own @ self.directions[t, node]
                if len(p):
                    self.cuts[t, node] = np.quantile(p, rng.uniform(0.4, 0.6))
                held[2 * node + 1], held[2 * node + 2] = own[p < self.cuts[t, node]], own[p >= self.cuts[t, node]]
            for node, own in held.items():
                if deeper and len(own):
                    self.low_cuts[t, node - nodes] = np.median(own @ self.low_directions[t].T, axis=0)

    def leaves(self, points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row, code) of each leaf that each row is in; codes differ between trees."""
        rows, codes = [], []
        for t in range(len(self.cuts)):
            row, node = np.arange(len(points)), np.zeros(len(points), np.int64)
            for _ in range(self.depth):
                gap = np.einsum("ij,ij->i", points[row], self.directions[t, node]) - self.cuts[t, node]
                low, high = gap < self.overlap, gap >= -self.overlap
                row, node = np.concatenate([row[low], row[high]]), np.concatenate([2 * node[low] + 1, 2 * node[high] + 2])
            code = leaf = node - (2**self.depth - 1)
            for level in range(self.deeper):
                gap = (points @ self.low_directions[t, level])[row] - self.low_cuts[t, leaf, level]
                low, high = gap < self.overlap, gap >= -self.overlap
                row, leaf = np.concatenate([row[low], row[high]]), np.concatenate([leaf[low], leaf[high]])
                code = np.concatenate([2 * code[low], 2 * code[high] + 1])
            rows.append(row)
            codes.append((t << 48) + code)
        return np.concatenate(rows), np.concatenate(codes)


def _directions(rng: np.random.Generator, *shape: int) -> np.ndarray:
    x = rng.standard_normal(shape)
    return x / np.linalg.norm(x, axis=-1, keepdims=True)


def _unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(axis=1, keepdims=True)  # so that squares neither vanish nor overflow
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _router(forest: Forest, dim: int, dtype: np.dtype):
    schema = pa.schema([("code", pa.int64()), ("label", pa.string()), ("node", pa.int64()), ("n", pa.int64()), ("vector", pa.binary()), ("codes", pa.binary())])

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = matrix(batch.column(3), dim)
            row, code = forest.leaves(_unit(x))
            order = np.lexsort((code, row))
            row, code = row[order], code[order]
            ends = np.searchsorted(row, np.arange(len(x) + 1))
            own = [code[a:b].tobytes() for a, b in zip(ends[:-1], ends[1:])]
            packed = [v.tobytes() for v in x.astype(dtype)]
            node, label, n = (batch.column(c) for c in range(3))
            for at in range(0, len(row), 20_000):
                r = row[at : at + 20_000]
                take = pa.array(r)
                columns = [code[at : at + 20_000], label.take(take), node.take(take), n.take(take), [packed[i] for i in r], [own[i] for i in r]]
                yield pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)

    return route


def _strangers(code: int, a: list[bytes], b: list[bytes]) -> np.ndarray:
    """Whether members of a and b, by their sorted leaves, share no leaf before this one."""
    earlier = [np.frombuffer(own, "<i8") for own in (*a, *b)]
    earlier = [own[own < code] for own in earlier]
    leaves, leaf = np.unique(np.concatenate(earlier), return_inverse=True)
    member = np.repeat(np.arange(len(earlier)), [len(own) for own in earlier])
    met = np.zeros((len(a), len(b)), bool)
    for begin in range(0, len(leaves), TILE):
        mine = (leaf >= begin) & (leaf < begin + TILE)
        held = np.zeros((len(earlier), min(TILE, len(leaves) - begin)), np.float32)
        held[member[mine], leaf[mine] - begin] = 1
        met |= held[: len(a)] @ held[len(a) :].T > 0
    return ~met


def _groups(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """The smallest of 0 to n - 1 that the pairs a, b join each of them to."""
    root = np.arange(n)
    while True:
        before = root.copy()
        low = np.minimum(root[a], root[b])
        np.minimum.at(root, a, low)
        np.minimum.at(root, b, low)
        root = root[root]
        if (root == before).all():
            return root


def _comparer(least: float, dtype: np.dtype, pairs: bool):
    """The links of a leaf's tiles that no earlier leaf has: as pairs (node, other), or as (node, null, weight linked) and
    stars (node, other, null) that join the same nodes."""

    def compare(key: tuple, part: pa.Table) -> pa.Table:
        code, i, j = key[0].as_py(), key[2].as_py(), key[3].as_py()
        order = np.argsort(part["node"].to_numpy())
        part = part.take(pa.array(order))
        x, node, side = _unit(unpacked(part["vector"], dtype)), part["node"].to_numpy(), part["tile"].to_numpy()
        left, right = np.flatnonzero(side == i), np.flatnonzero(side == j)
        linked = x[left] @ x[right].T >= least
        if i == j:
            linked = np.triu(linked, 1)  # nodes ascend
        left, right, linked = left[linked.any(axis=1)], right[linked.any(axis=0)], linked[np.ix_(linked.any(axis=1), linked.any(axis=0))]
        if linked.size:
            codes = lambda at: part["codes"].take(pa.array(at)).to_pylist()
            linked &= _strangers(code, codes(left), codes(right))
        p, q = np.nonzero(linked)
        p, q = left[p], right[q]
        if pairs:
            return pa.table({"node": np.minimum(node[p], node[q]), "other": np.maximum(node[p], node[q]), "linked": pa.nulls(len(p), pa.int64())})
        n = part["n"].to_numpy()
        total = np.zeros(len(node), np.int64)
        np.add.at(total, p, n[q])
        np.add.at(total, q, n[p])
        root = _groups(p, q, len(node))
        some, tied = np.flatnonzero(total), np.flatnonzero(root < np.arange(len(node)))
        nodes = pa.array(np.concatenate([node[some], node[tied]]))
        other = pa.chunked_array([pa.nulls(len(some), pa.int64()), pa.array(node[root[tied]])])
        return pa.table({"node": nodes, "other": other, "linked": pa.chunked_array([pa.array(total[some]), pa.nulls(len(tied), pa.int64())])})

    return compare


def _found(nodes: DataFrame, least: float, trees: int, pairs: bool) -> DataFrame:
    """What _comparer gives for nodes (node, label string, n, vector) of one dimension."""
    dtype, dim = dtype_of(nodes, "vector"), common_dim(nodes, "vector")
    points = _unit(sample(nodes, "vector", "node", SAMPLE))
    mates = nodes.groupBy("label").count().agg((F.sum(F.col("count").cast("double") ** 2) / F.sum("count")).alias("m")).first()["m"]
    levels = max(0, math.ceil(math.log2(mates / LEAF)))
    depth = min(levels, math.floor(math.log2(max(len(points), 8) / 8)))
    forest = Forest(points, trees, depth, OVERLAP * math.sqrt(max(2 - 2 * least, 0.0) / dim), levels - depth)
    routed = nodes.select("node", "label", "n", "vector").mapInArrow(_router(forest, dim, dtype), "code long, label string, node long, n long, vector binary, codes binary")
    routed, _ = written(routed)
    large = routed.groupBy("code", "label").agg(F.ceil(F.count("*") / TILE).cast("int").alias("tiles")).where("tiles > 1")
    tiled = routed.join(large, ["code", "label"], "left").withColumn("tiles", F.coalesce("tiles", F.lit(1)))
    tiled = tiled.withColumn("tile", F.pmod(F.xxhash64("node"), F.col("tiles")).cast("int"))
    tiled = tiled.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1))).withColumns({"i": F.least("tile", "other"), "j": F.greatest("tile", "other")})
    tiled = tiled.select("code", "label", "i", "j", "tile", "node", "n", "vector", "codes")
    return tiled.groupBy("code", "label", "i", "j").applyInArrow(_comparer(least, dtype, pairs), "node long, other long, linked long")


def links(nodes: DataFrame, least: float, trees: int = TREES) -> DataFrame:
    """Pairs (a, b), a < b, of nodes (node, label, vector) with equal labels and a cosine of least or more, each once. Only
    vectors of the most frequent dimension are looked at."""
    dim = common_dim(nodes, "vector")
    if not dim:
        return nodes.sparkSession.createDataFrame([], "a long, b long")
    nodes = nodes.where(F.size("vector") == dim).select("node", F.col("label").cast("string").alias("label"), F.lit(1).cast("long").alias("n"), "vector")
    return _found(nodes, least, trees, True).select(F.col("node").alias("a"), F.col("other").alias("b"))


def _probed(nodes: DataFrame, least: float) -> int:
    """How many links PROBES of the nodes have, by brute force: those with the smallest hash, against all in blocks."""
    dim = common_dim(nodes, "vector")
    asked = nodes.select("node", "label", "vector", F.xxhash64("node").alias("_h")).orderBy("_h", "node").limit(PROBES).collect()
    q = _unit(np.array([r["vector"] for r in asked], np.float64))
    labels, own = np.array([r["label"] for r in asked]), np.array([r["node"] for r in asked])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hit = _unit(matrix(batch.column(3), dim)) @ q.T >= least
            hit &= (np.array(batch.column(1).to_pylist())[:, None] == labels) & (batch.column(0).to_numpy()[:, None] != own)
            yield pa.RecordBatch.from_arrays([pa.array([int(batch.column(2).to_numpy() @ hit.sum(axis=1))])], names=["links"])

    return nodes.select("node", "label", "n", "vector").mapInArrow(count, "links long").agg(F.sum("links")).first()[0] or 0


def _tied(nodes: DataFrame, least: float) -> DataFrame:
    """(node, other, linked) by as many trees as it takes."""
    wanted = _probed(nodes, least)
    asked = F.broadcast(nodes.select("node", F.xxhash64("node").alias("_h")).orderBy("_h", "node").limit(PROBES).select("node"))
    trees = TREES
    while True:
        found, path = written(_found(nodes, least, trees, False))
        got = found.join(asked, "node", "left_semi").agg(F.sum("linked")).first()[0] or 0
        if got >= RECALL * wanted or trees >= MOST_TREES:
            return found
        drop(nodes.sparkSession, path)
        trees *= 2


def near_duplicates(table: DataFrame, least: float = 0.98, vec_id: str = "vec_id", vector: str = "embedding", label: str = "label") -> DataFrame:
    """(vec_id, n_links, component_id, kept) for each row of table.

    Two vectors link if their labels are equal and not null and their cosine is least or more. n_links counts the other
    ids linked directly, component_id is the smallest id that links reach, kept tells whether that is the row's own.
    Vectors that are null, zero or hold null or non-finite components link with nothing, nor do rows with a null id, whose
    component is null. Each dimension has a forest of its own. Repeated rows keep their rows and count as one id. Labels are
    compared as text. Other columns don't matter.
    """
    spark = table.sparkSession
    rows = table.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(label).cast("string").alias("label"), F.col(vector).alias("vector"))
    usable_row = usable("vector") & F.col("label").isNotNull() & F.col("vec_id").isNotNull()
    keyed = rows.withColumns({"h1": F.when(usable_row, F.xxhash64("vector")), "h2": F.when(usable_row, F.xxhash64(F.lit(1), "vector"))})
    valid = keyed.where("h1 is not null")
    ids = valid.groupBy("label", "h1", "h2", "vec_id").agg(F.first("vector").alias("vector"))
    classes, _ = written(ids.groupBy("label", "h1", "h2").agg(F.min("vec_id").alias("node"), F.count("*").alias("n"), F.first("vector").alias("vector")))
    tied = spark.createDataFrame([], "node long, other long, linked long")
    for r in classes.select(F.size("vector").alias("dim")).distinct().orderBy("dim").collect():
        tied = tied.union(_tied(classes.where(F.size("vector") == r["dim"]).select("node", "label", "n", "vector"), least))
    degree = tied.where("linked is not null").groupBy("node").agg(F.sum("linked").alias("linked"))
    ties = components(tied.where("other is not null"), "node", "other")
    known = classes.select("label", "h1", "h2", "node", "n").join(degree, "node", "left").join(ties, "node", "left")
    known = known.select("label", "h1", "h2", (F.coalesce("linked", F.lit(0)) + F.col("n") - 1).alias("n_links"), F.coalesce("component", "node").alias("component_id"))
    out = keyed.select("vec_id", "label", "h1", "h2").join(known, ["label", "h1", "h2"], "left")
    component = F.coalesce("component_id", "vec_id")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(False)).alias("kept"))
