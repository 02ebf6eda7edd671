"""Hash trees against plain hashing, and projections against a product."""

import hashlib

import numpy as np
import pytest

from strandlake.operators import integrity, projections


def node(a, b):
    frame = lambda x: len(x).to_bytes(4, "big") + x
    return hashlib.sha256(frame(b"NODE") + frame(bytes.fromhex(a)) + frame(bytes.fromhex(b))).hexdigest()


def root(hashes):
    while len(hashes) > 1:
        hashes = [node(hashes[i], hashes[min(i + 1, len(hashes) - 1)]) for i in range(0, len(hashes), 2)]
    return hashes[0]


@pytest.mark.parametrize("n", [1, 2, 3, 5, 8, 13])
def test_claims_of_trees_of_all_shapes(spark, n):
    hashes = [hashlib.sha256(str(i).encode()).hexdigest() for i in range(n)]
    leaves = spark.createDataFrame(list(enumerate(hashes)), "idx long, hash string")
    wrong = hashlib.sha256(b"wrong").hexdigest()
    claims = [*enumerate(hashes), *((i, wrong) for i in range(n)), (0, hashes[0]), (n, hashes[-1]), (-1, hashes[0]), (None, wrong), (0, None)]
    got = sorted(integrity.merkle_verified(leaves, spark.createDataFrame(claims, "idx long, hash string")).collect(), key=str)
    want = sorted(((i, i is not None and 0 <= i < n and h == hashes[i]) for i, h in claims), key=str)
    assert sorted(map(tuple, got), key=str) == want
    assert integrity.merkle_levels(leaves)[-1].first()["hash"] == root(hashes)


def test_no_leaves(spark):
    claims = spark.createDataFrame([(0, "00")], "idx long, hash string")
    assert [r["valid"] for r in integrity.merkle_verified(claims.limit(0), claims).collect()] == [False]


@pytest.mark.parametrize("kind", projections.KINDS)
def test_projections(spark, kind):
    m = projections.matrix(kind, 40, 60, seed=1)
    if kind == "orthogonal":
        assert np.allclose(m @ m.T, np.eye(40)) and np.allclose(projections.matrix(kind, 60, 40).T @ projections.matrix(kind, 60, 40), np.eye(40))
    elif kind == "sparse":
        assert 0.05 < (m != 0).mean() < 0.15 and set(np.round(np.abs(m[m != 0]) * np.sqrt(6), 9)) == {1.0}
    else:
        assert abs(m.std() * np.sqrt(60) - 1) < 0.1
    rows = [(i, np.random.default_rng(i).random(60).tolist()) for i in range(20)] + [(50, None), (51, [1.0]), (52, [None] + [0.0] * 59)]
    got = {r["id"]: r["vector"] for r in projections.project(spark.createDataFrame(rows, "id long, vector array<double>").repartition(3), 40, 60, kind, seed=1).collect()}
    assert all(np.allclose(got[i], m @ np.array(v)) for i, v in rows[:20]) and [got[i] for i in (50, 51, 52)] == [None] * 3


def test_unknown_projection(spark):
    with pytest.raises(ValueError, match="unknown projection"):
        projections.project(spark.createDataFrame([(1, [1.0])], "id long, vector array<double>"), 1, 1, "other")
