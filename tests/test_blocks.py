"""Queries on vectors by blocks, and what larger tables showed, against DuckDB and plain code."""

import duckdb
import numpy as np
import pytest

from strandlake import catalog


def same(spark, name, folder, tables, digits=4):
    con = duckdb.connect()
    for t in tables:
        con.execute(f"create view {t} as select * from '{folder}/{t}.parquet/*.parquet'")
    want = con.sql(catalog.oracle_sql()[name])
    columns = sorted(want.columns)
    plain = lambda rows: sorted(tuple(round(x, digits) if isinstance(x, float) else x for x in r) for r in rows)
    got = plain(tuple(r[c] for c in columns) for r in catalog.queries()[name](spark, folder).collect())
    assert got == plain(want.select(*columns).fetchall())
    return len(got)


def test_derived_ratio_rounds_as_sql(spark, tmp_path):
    rows = [(1, 991.8, 6), (2, 904.6, 2), (3, 917.4, 2), (4, 5.0, 0), (5, None, 3), (6, -991.8, 6)]
    spark.createDataFrame(rows, "p_partkey long, p_retailprice double, p_size int").write.parquet(f"{tmp_path}/part.parquet")
    got = {r["p_partkey"]: r["value"] for r in catalog.queries()["derived_ratio"](spark, str(tmp_path)).collect()}
    want = dict(duckdb.connect().execute(f"select p_partkey, value from ({catalog.oracle_sql()['derived_ratio'].replace('FROM part', f'''FROM '{tmp_path}/part.parquet/*.parquet' ''')})").fetchall())
    assert got == want and got[1] == 27.6


@pytest.fixture(scope="module")
def vectors(spark, tmp_path_factory):
    """Vectors with copies, distances about the limits, and labels of unequal size."""
    folder, rng = str(tmp_path_factory.mktemp("vectors")), np.random.default_rng(5)
    v = rng.normal(size=(220, 8))
    v = (v / np.linalg.norm(v, axis=1)[:, None]).astype(np.float32)
    v[200:] = v[:20]
    rows = [(i * 5, v[i].tolist(), [0, 0, 0, 1, 2, 7][i % 6]) for i in range(220)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").write.parquet(f"{folder}/embeddings.parquet")
    return folder


@pytest.mark.parametrize("name", ["vr_edges", "vr_triangles", "persistence_filter", "knn_score", "neighbor_jaccard"])
def test_blocks_equal_sql(spark, vectors, monkeypatch, name):
    from strandlake.operators import blocks

    for size in ("ROWS", "ASKED", "TRIPLE"):
        monkeypatch.setattr(blocks, size, 40)
    monkeypatch.setattr(blocks, "OUT", 64)
    assert same(spark, name, vectors, ["embeddings"]) > 0


def test_triangles_of_every_label(spark, vectors):
    label = {r["vec_id"]: r["label"] for r in spark.read.parquet(f"{vectors}/embeddings.parquet").collect()}
    found = catalog.queries()["vr_triangles"](spark, vectors).select("a").collect()
    assert {label[r["a"]] for r in found} == {0, 1, 2, 7}


def test_labels_have_as_many_parts_as_they_need(spark, monkeypatch):
    from strandlake.operators import blocks

    monkeypatch.setattr(blocks, "TRIPLE", 20)
    rows = spark.createDataFrame([(label, 100 * label + i, [float(i)]) for label in range(12) for i in range(60 if label == 3 else 20)], "label int, id long, v array<double>")
    copies = dict(blocks._triples(rows).groupBy("label").count().collect())
    assert copies == {label: 60 * 6 if label == 3 else 20 for label in range(12)}  # 3 parts: each row meets 6 pairs of them
    found = {tuple(r) for r in blocks.triangles(rows, 1.0).collect()}
    assert found == set()
    found = {tuple(r) for r in blocks.triangles(rows, 2.0).collect()}
    assert found == {(100 * label + i, 100 * label + i + 1, 100 * label + i + 2, 2.0) for label in range(12) for i in range(58 if label == 3 else 18)}


def test_blocks_leave_no_nested_loop(spark, vectors):
    for name in ("vr_edges", "vr_triangles", "persistence_filter", "knn_score", "neighbor_jaccard", "pairwise_hamming"):
        plan = catalog.queries()[name](spark, vectors)._jdf.queryExecution().optimizedPlan().toString()
        assert "zip_with" not in plan and "NestedLoop" not in plan, name


def test_null_vectors_come_last_and_have_no_distance(spark):
    from strandlake.operators import blocks

    rows = spark.createDataFrame([(0, [1.0, 0.0]), (1, None), (2, [0.5, None]), (3, [0.5, 2.0]), (4, [1.0])], "id long, v array<float>")
    got = [tuple(r) for r in blocks.nearest_of(rows.where("id = 0"), rows, 3).select("vec_id", "rank", "score").orderBy("rank").collect()]
    assert got == [(3, 1, 0.5), (1, 2, None), (2, 3, None)]
    apart = {r["b"]: r["distance"] for r in blocks.hamming_of(rows.where("id = 0"), rows).collect()}
    assert apart == {1: None, 2: None, 3: 1, 4: None}
    labelled = rows.selectExpr("0 as label", "id", "v")
    assert [tuple(r)[:2] for r in blocks.close_pairs(labelled, 9.0).collect()] == [(0, 3)]
    assert blocks.triangles(labelled, 9.0).count() == 0


def test_level_diagrams_match_by_rank_and_in_time(spark):
    import time

    from strandlake.operators.diagrams import bottleneck, bottleneck_distances

    rng = np.random.default_rng(2)
    small = {n: np.c_[np.full(m, 1.0), 1.0 + rng.random(m)] for n, m in (("a", 30), ("b", 41), ("c", 1))}
    rows = [(n, *map(float, p)) for n, points in small.items() for p in points]
    rows += [(n, 0.0, float(d)) for n, m in (("x", 2500), ("y", 3000)) for d in rng.random(m)]
    df = spark.createDataFrame(rows, "diagram string, birth double, death double")
    pairs = spark.createDataFrame([("a", "b"), ("a", "c"), ("b", "c"), ("x", "y"), ("a", "none"), ("a", "b")], "a string, b string")
    begun = time.monotonic()
    got = [tuple(r) for r in bottleneck_distances(df, pairs).collect()]
    assert time.monotonic() - begun < 60 and len(got) == 6
    got = {r[:2]: r[2] for r in got}
    for a, b in (("a", "b"), ("a", "c"), ("b", "c")):
        assert got[a, b] == pytest.approx(bottleneck(small[a], small[b]))
    assert got["a", "none"] == pytest.approx((small["a"][:, 1].max() - 1) / 2)
    x, y = (np.sort([r[2] for r in rows if r[0] == n])[::-1] for n in "xy")
    x = np.pad(x, (0, 500))
    assert got["x", "y"] == pytest.approx(np.minimum(abs(x - y), np.maximum(x, y) / 2).max())
