"""Previous and first rows of series, against a window over the whole series."""

import random

import pytest
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from strandlake.operators import sequences


def series(spark, n=3000):
    rng = random.Random(4)
    rows = [(i, rng.choice(["hot"] * 5 + ["a", "b", None]), float(rng.randint(0, 10**6)), None if rng.random() < 0.05 else [rng.random(), 1.0], "x") for i in range(n)]
    rows += [(n, "alone", 5.0, [0.0], "x"), (n + 1, "a", None, [7.0], "x"), (n + 2, "late", float("nan"), [8.0], "x"), (n + 3, "late", 1.0, [9.0], "x")]
    return spark.createDataFrame(rows, "id long, label string, at double, v array<double>, range string").repartition(5)


@pytest.mark.parametrize("ranges", [2, 7, 64])
def test_previous_is_lag(spark, ranges):
    df = series(spark).dropDuplicates(["label", "at"])
    got = {r["id"]: r["previous"] for r in sequences.beside_previous(df, "label", "at", "v", ranges=ranges).collect()}
    want = {r["id"]: r["p"] for r in df.withColumn("p", F.lag("v").over(W.partitionBy("label").orderBy("at"))).collect()}
    assert got == want
    assert sum(x is not None for x in got.values()) > 2500


def test_ties_repeats_and_empty_tables(spark):
    df = spark.createDataFrame([(1, 5, 2), (1, 5, 1), (1, 5, 2), (2, 5, 9), (1, 6, 0)], "k int, o int, v int")
    out = sequences.beside_previous(df, "k", "o", "v", "p", ranges=4)
    assert out.columns == ["k", "o", "v", "p"]
    assert sorted((tuple(r) for r in out.collect()), key=str) == sorted([(1, 5, 1, None), (1, 5, 2, 1), (1, 5, 2, 2), (1, 6, 0, 2), (2, 5, 9, None)], key=str)
    assert sequences.beside_previous(df.limit(0), "k", "o", "v").count() == 0
    assert sequences.beside_previous(df.where("k = 2"), "k", "o", "v").collect()[0]["previous"] is None


def test_no_task_orders_a_whole_series(spark):
    plan = sequences.beside_previous(series(spark), "label", "at", "v")._jdf.queryExecution().optimizedPlan().toString()
    windows = [x for x in plan.splitlines() if " Window [" in x or x.startswith("Window [")]
    assert len(windows) == 2 and all("range" in x for x in windows)


def test_first(spark):
    df = series(spark).where("at is not null")
    got = {r["id"]: r["first"] for r in sequences.beside_first(df, "label", "at", "v").collect()}
    w = W.partitionBy("label").orderBy("at", "v")
    assert got == {r["id"]: r["f"] for r in df.withColumn("f", F.first("v").over(w)).collect()}
