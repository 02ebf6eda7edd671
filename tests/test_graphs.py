"""Neighbour graphs and persistence against brute force."""

import math
import random

import numpy as np
import pytest

from strandlake.operators import neighbors
from strandlake.operators.neighbors import knn_graph, preserved
from strandlake.operators.topology import h0_persistence

SCHEMA = "id long, vector array<float>, v int, rep int, score int"


def frame(spark, rows):
    return spark.createDataFrame([(i, v, 1, 2, 3) for i, v in rows], SCHEMA).repartition(4)


def brute(rows, k, metric):
    good = {i: np.array(v, np.float32).astype(float) for i, v in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)}
    if metric == "cosine":
        good = {i: v / np.sqrt((v * v).sum()) for i, v in good.items() if (v * v).sum() > 0}
    score = lambda a, b: round(float(a @ b) if metric == "cosine" else -float(np.sqrt(((a - b) ** 2).sum())), 9)# noqa: E731
    out = {}
    for i, v in good.items():
        near = sorted((-score(v, u), j) for j, u in good.items() if j != i)[:k]
        out |= {(i, r + 1): (j, -s) for r, (s, j) in enumerate(near)}
    return out


def vectors(rng, clusters):
    centers = rng.normal(size=(clusters, 6)) * 20
    rows = [(i, (centers[i % clusters] + rng.integers(-3, 4, 6) / 2).tolist()) for i in range(240)]
    rows += [(1000 + i, rows[7][1]) for i in range(15)]  # copies, more than k
    return rows + [(2000, None), (2001, [0.0] * 6), (2002, [1.0, None] + [0.0] * 4), (2003, [math.nan] + [1.0] * 5), (2004, [math.inf] + [1.0] * 5)]


@pytest.mark.parametrize("metric,block_rows", [("cosine", None), ("cosine", 20), ("euclidean", 16)])
def test_knn_graph_equals_brute_force(spark, metric, block_rows):
    rows = vectors(np.random.default_rng(3), 12)
    got = {(r["id"], r["rank"]): (r["near"], r["score"]) for r in knn_graph(frame(spark, rows), 4, metric, block_rows).collect()}
    want = brute(rows, 4, metric)
    assert got.keys() == want.keys()
    assert all(abs(got[x][1] - want[x][1]) < 2e-9 for x in want)
    assert sum(got[x][0] != want[x][0] for x in want) <= 4  # where sums in another order round otherwise


def test_blocks_are_pruned_where_vectors_have_structure():
    rng = np.random.default_rng(0)
    pivots = rng.normal(size=(50, 3)) * 100
    run = neighbors._pairs(pivots, np.ones(50), np.full(50, 20), np.full(50, 2.0), 10)
    import pyarrow as pa

    (pairs,) = [list(run(iter([pa.RecordBatch.from_arrays([pa.array([0])], ["id"])])))]
    assert sum(b.num_rows for b in pairs) < 5


def test_few_rows_and_none(spark):
    assert knn_graph(frame(spark, []), 3).count() == 0
    assert knn_graph(frame(spark, [(1, [1.0, 0.0])]), 3).count() == 0
    got = sorted(tuple(r)[:3] for r in knn_graph(frame(spark, [(1, [1.0, 0.0]), (2, [0.0, 1.0]), (5, [2.0, 0.0])]), 3).collect())
    assert got == [(1, 1, 5), (1, 2, 2), (2, 1, 1), (2, 2, 5), (5, 1, 1), (5, 2, 2)]


def test_preserved(spark):
    a = spark.createDataFrame([(1, 2), (1, 3), (2, 1)], "id long, near long")
    b = spark.createDataFrame([(1, 3), (1, 4), (3, 1)], "id long, near long")
    assert {r["id"]: (r["common"], round(r["jaccard"], 6)) for r in preserved(a, b).collect()} == {1: (1, 0.333333), 2: (0, 0.0), 3: (0, 0.0)}


def kruskal(edges, extra=()):
    up = {v: v for a, b, _ in edges for v in (a, b) if v is not None} | {v: v for v in extra}

    def find(v):
        while up[v] != v:
            v = up[v]
        return v

    out = []
    for w, a, b in sorted((w, min(a, b), max(a, b)) for a, b, w in edges if a != b and w is not None and not math.isnan(w)):
        x, y = find(a), find(b)
        if x != y:
            up[max(x, y)] = min(x, y)
            out.append((a, b, w))
    return sorted([*out, *((v, v, None) for v in up if up[v] == v)], key=str)


def test_h0_equals_kruskal(spark):
    rng = random.Random(5)
    some = [(rng.randint(0, 60), rng.randint(0, 60), rng.randint(1, 9) / 2) for _ in range(110)]  # ties, loops and parallel edges
    chain = [(i, i + 1, float(200 - i)) for i in range(100, 180)]  # long pointers
    odd = [(300, 301, None), (302, 303, math.nan), (304, 304, 1.0)]
    edges = some + chain + odd
    df = spark.createDataFrame(edges, "a long, b long, w double")
    extra = spark.createDataFrame([(500,), (3,), (None,)], "v long")
    got = sorted((tuple(r) for r in h0_persistence(df, extra).select("a", "b", "death").collect()), key=str)
    assert got == kruskal(edges, [500])
    assert h0_persistence(df.limit(0)).count() == 0
