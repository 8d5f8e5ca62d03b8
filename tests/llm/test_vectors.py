import numpy as np
from pyspark.sql import functions as F

from strandwork.llm import vector_dedup, vector_search

SCHEMA = "vec_id long, embedding array<float>, label int, node string, code int"


def rows_of(x, labels):
    rows = [(i, [float(v) for v in row], int(y), "clash", 1) for i, (row, y) in enumerate(zip(x, labels))]
    n = len(rows)
    odd = [None, [], [0.0] * x.shape[1], [float("nan")] * x.shape[1], [None] * x.shape[1], [float("inf")] * x.shape[1], [1.0]]
    rows += [(n + k, v, 1, "clash", 1) for k, v in enumerate(odd)]
    rows += [(n + 50, rows[0][1], None, "clash", 1), (None, rows[1][1], 1, "clash", 1), rows[2]]
    return rows, n


def near_copies(seed=1, n=600, dim=32):
    rng = np.random.default_rng(seed)
    x = rng.standard_normal((n, dim))
    for i in range(n // 2, n):
        x[i] = x[rng.integers(0, 40)] + rng.standard_normal(dim) * rng.choice([0, 0.05, 0.15])
    return x.astype(np.float32), rng.integers(0, 3, n)


def test_near_duplicates_are_brute_force_s(spark):
    x, labels = near_copies()
    rows, n = rows_of(x, labels)
    got = vector_dedup.near_duplicates(spark.createDataFrame(rows, SCHEMA).repartition(3)).collect()
    assert len(got) == len(rows)
    u = x.astype(np.float64)
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    linked = (u @ u.T >= 0.98) & (labels[:, None] == labels[None])
    root = list(range(n))
    changed = True
    while changed:
        low = [min(root[j] for j in np.flatnonzero(linked[i])) for i in range(n)]
        changed, root = low != root, low
    for r in got:
        i = r["vec_id"]
        if i is None:
            assert (r["n_links"], r["component_id"], r["kept"]) == (0, None, False)
        elif i < n:
            assert (r["n_links"], r["component_id"], r["kept"]) == (linked[i].sum() - 1, root[i], root[i] == i)
        else:
            assert (r["n_links"], r["component_id"], r["kept"]) == (0, i, True)
    assert vector_dedup.near_duplicates(spark.createDataFrame([], SCHEMA)).count() == 0


def test_tiles_lose_nothing(spark, monkeypatch):
    monkeypatch.setattr(vector_dedup, "TILE", 64)
    x, _ = near_copies(3, 400)
    x[:] = x[0] + np.random.default_rng(5).standard_normal(x.shape).astype(np.float32) * 0.02
    nodes = spark.createDataFrame([(i, [float(v) for v in row], 1) for i, row in enumerate(x)], "node long, vector array<float>, label long")
    pairs = [tuple(r) for r in vector_dedup.links(nodes, 0.98).collect()]
    u = x.astype(np.float64)
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    want = {(i, j) for i, j in zip(*np.nonzero(u @ u.T >= 0.98)) if i < j}
    assert len(pairs) == len(set(pairs)) and set(pairs) == want


def test_search_reaches_its_recall(spark, monkeypatch):
    monkeypatch.setattr(vector_search, "LEAF", 32)
    x, labels = near_copies(7, 2000, 16)
    rows, n = rows_of(x, labels)
    got = vector_search.search(spark.createDataFrame(rows, SCHEMA).repartition(4), F.col("vec_id") % 20 == 0).toPandas()
    x = x.astype(np.float64)
    hits, total = 0, 0
    for q, own in got.groupby("query_id"):
        own = own.sort_values("rank")
        assert own["rank"].tolist() == list(range(1, 21)) and q not in set(own.vec_id)
        s = x @ x[q]
        assert np.allclose(own.score, s[own.vec_id])
        assert sorted(zip(-own.score, own.vec_id)) == list(zip(-own.score, own.vec_id))
        s[q] = -np.inf
        hits += len(set(np.lexsort((np.arange(n), -s))[:20]) & set(own.vec_id))
        total += 20
    assert total == 20 * len([i for i in range(n) if i % 20 == 0]) and hits / total >= 0.9


def test_search_in_few_rows(spark):
    small = spark.createDataFrame([(0, [1.0, 0.0], 1, "", 1), (1, [1.0, 0.0], 1, "", 1), (2, [0.5, 0.5], 1, "", 1), (3, None, 1, "", 1)], SCHEMA)
    got = vector_search.search(small, F.col("vec_id") % 20 == 0).orderBy("rank").collect()
    assert [(r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in got] == [(0, 1, 1, 1.0), (0, 2, 2, 0.5)]
    assert vector_search.search(small.limit(0), F.col("vec_id") % 20 == 0).count() == 0
    one = small.where("vec_id = 0")
    assert vector_search.search(one, F.col("vec_id") % 20 == 0).count() == 0
