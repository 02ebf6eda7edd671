"""Drift and shape of series against numpy, one series at a time."""

import random

import numpy as np
import pytest
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from strandlake.operators import sequences, trajectories


def rows(n=700):
    rng = random.Random(5)
    out = [(i, rng.choice(["hot"] * 4 + ["a", None]), None if rng.random() < 0.03 else [rng.gauss(0.4, 1) for _ in range(3)], "r") for i in range(n)]
    return [*out, (n, "one", [1.0, 0.0, 0.0], "r"), (n + 1, "two", [1.0, 0.0, 0.0], "r"), (n + 2, "two", [1.0, 2.0, 0.0], "r"), (n + 3, "none", None, "r"), *((n + 4 + i, "still", [1.0, 1.0, 1.0], "r") for i in range(6))]


def frame(spark):
    return spark.createDataFrame(rows(), "id long, label string, v array<double>, range string").repartition(4)


def by_label():
    out = {}
    for i, label, v, _ in rows():
        out.setdefault(label, []).append((i, v))
    return out


def test_drift(spark):
    got = {r["id"]: r for r in trajectories.drift_flags(frame(spark), "label", "id", "v", threshold=0.8).collect()}
    seen = 0
    for series in by_label().values():
        drifts = []
        for (_, a), (i, b) in zip(series, series[1:], strict=False):
            if a is None or b is None:
                assert i not in got
                continue
            drifts.append(1 - np.dot(a, b) / (np.linalg.norm(a) * np.linalg.norm(b)))
            r = got[i]
            assert r["drift"] == pytest.approx(drifts[-1], abs=1e-9) and r["flagged"] == (r["drift"] > 0.8) and r["range"] == "r"
            if len(drifts) < 5:
                assert r["rolling"] is None and r["sustained"] is None
            else:
                assert r["rolling"] == pytest.approx(np.mean(drifts[-5:]), abs=1e-9) and r["sustained"] == (r["rolling"] > 0.64)
            seen += 1
    assert seen == len(got) > 500
    assert trajectories.drift_flags(frame(spark).limit(0), "label", "id", "v").count() == 0


def test_shape(spark):
    got = {r["label"]: r for r in trajectories.shape(frame(spark), "label", "id", "v").collect()}
    want = {k: np.array([v for _, v in x if v is not None]) for k, x in by_label().items()}
    assert set(got) == {k for k, x in want.items() if len(x)}
    for label, r in got.items():
        steps = np.diff(want[label], axis=0)
        path, direct = np.linalg.norm(steps, axis=1).sum(), np.linalg.norm(want[label][-1] - want[label][0])
        assert (r["n"], r["path"], r["direct"], r["efficiency"]) == pytest.approx((len(want[label]), path, direct, direct / (path + 1e-8)))
        if r["n"] < 3:
            assert (r["smoothness"], r["avg_curvature"], r["max_curvature"]) == (1, 0, 0)
            continue
        angles = [np.arccos(np.clip(a @ b / (np.linalg.norm(a) * np.linalg.norm(b) + 1e-8), -1, 1)) for a, b in zip(steps, steps[1:], strict=False)]
        assert (r["smoothness"], r["avg_curvature"], r["max_curvature"]) == pytest.approx((path / (direct + 1e-8), np.mean(angles), max(angles)))


@pytest.mark.parametrize("ranges", [3, 64, 200])
def test_windows_look_back_over_several_ranges(spark, ranges):
    df = frame(spark).select("id", "label", F.col("id").alias("x"))
    made = lambda w: {"total": F.sum("x").over(w.rowsBetween(-6, 0)), "sixth": F.lag("x", 6).over(w)}
    got = sequences.over_last(df, "label", "id", ["x"], 6, made, ranges)
    want = df.select("*", *(c.alias(k) for k, c in made(W.partitionBy("label").orderBy("id")).items()))
    assert sorted(tuple(r) for r in got.select("id", "total", "sixth").collect() if r["sixth"] is not None) == sorted(tuple(r) for r in want.select("id", "total", "sixth").collect() if r["sixth"] is not None)
    assert got.count() == want.count() and got.columns == want.columns
