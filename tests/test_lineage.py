"""Lineage against walking up node by node, and masked sums whatever the ids."""

import random

from strandlake.operators import federated
from strandlake.operators.lineage import lineage


def walked(edges):
    up, out = {}, {}
    for c, p in edges:
        if c is not None and p is not None:
            up[c] = min(p, up.get(c, p))
    for node in up:
        path = [node]
        while path[-1] in up and len(path) <= len(up) + 1:
            path.append(up[path[-1]])
        out[node] = (None, None, True, None) if path[-1] in up else (path[-1], len(path) - 1, False, path[::-1])
    return out


def test_trees_chains_rings_and_odd_edges(spark):
    rng = random.Random(4)
    edges = [(i, rng.randrange(i)) for i in range(1, 120)]
    edges += [(1000 + i, 1001 + i) for i in range(70)]  # a long chain up to 1070
    edges += [(2000, 2001), (2001, 2002), (2002, 2000), (2003, 2000), (2010, 2010)]  # rings, one below a ring
    edges += [(3000, 3002), (3000, 3001), (3000, 3001), (None, 5), (6, None)]
    df = spark.createDataFrame(edges, "child long, parent long").repartition(3)
    got = {r["node"]: (r["root"], r["ancestors"], r["cyclic"], r["path"]) for r in lineage(df, paths=True).collect()}
    assert got == walked(edges)
    assert {r["node"]: r["ancestors"] for r in lineage(df).collect()} == {k: v[1] for k, v in walked(edges).items()}
    assert lineage(df.limit(0)).count() == 0


def test_a_hundred_thousand_nodes_need_no_recursion(spark):
    parts = spark.range(1, 100_001).selectExpr("id as child", "id div 2 as parent")
    assert lineage(parts).groupBy().sum("ancestors").first()[0] == sum(i.bit_length() for i in range(1, 100_001))


def test_masks_cancel_whatever_ids_are_missing(spark):
    rows = [(c, [float(c), 1.5, -2.0], 1) for c in (1, 5, 9, 1000, -7)]
    df = spark.createDataFrame(rows, "client long, vector array<double>, n int")
    for bucket in (1, 2, 100):
        got = {r["pos"]: round(r["value"], 9) for r in federated.masked_sums(df, bucket).collect()}
        assert got == {0: 1008.0, 1: 7.5, 2: -10.0}
    assert federated.masked_sums(df.limit(0)).count() == 0
