"""Calibrators against numpy and a plain pool of adjacent violators."""

import math
import random

import numpy as np
import pytest

from strandlake.operators import calibration, steps
from strandlake.operators.calibration import calibrated, isotonic, platt

SCHEMA = "id long, label int, score double, n long, pos int"


def frame(spark, labels, scores):
    return spark.createDataFrame([(i, y, s, 7, 7) for i, (y, s) in enumerate(zip(labels, scores, strict=True))], SCHEMA).repartition(3)


def newton(y, x, rounds=100, ridge=1e-6):
    design, w = np.c_[np.ones_like(x), x], np.zeros(2)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-design @ w))
        delta = np.linalg.solve((design.T * (p * (1 - p) + 1e-12)) @ design + ridge * np.eye(2), design.T @ (y - p) - ridge * w)
        w = w + delta
        if np.linalg.norm(delta) < 1e-8:
            break
    return w


def least_squares(labels, scores):
    """The best non-decreasing fit by its min-max formula, at each distinct score."""
    xs = sorted(set(scores))
    sums = [(sum(s == x for s in scores), sum(y for y, s in zip(labels, scores, strict=True) if s == x)) for x in xs]
    mean = lambda a, b: sum(p for _, p in sums[a : b + 1]) / sum(n for n, _ in sums[a : b + 1])
    return {x: max(min(mean(a, b) for b in range(i, len(xs))) for a in range(i + 1)) for i, x in enumerate(xs)}


def poorly_calibrated(n):
    rng = np.random.default_rng(0)
    y = rng.integers(0, 2, n)
    return y.tolist(), np.clip((0.2 + 0.3 * rng.random(n) + 0.2 * y) ** 0.5 + rng.normal(0, 0.05, n), 0, 1).tolist()


def test_platt_equals_newton_and_lowers_brier(spark):
    y, s = poorly_calibrated(400)
    rows = frame(spark, y, s)
    assert np.allclose(platt(rows), newton(np.array(y, float), np.array(s)), rtol=1e-6)
    brier = {r["method"]: r["brier"] for r in calibration.by_method(rows).collect()}
    assert brier["isotonic"] <= brier["platt"] <= brier["none"]


def test_platt_of_one_class_and_of_parted_classes(spark):
    assert platt(frame(spark, [], [])) == (0.0, 0.0)
    ones = calibrated(frame(spark, [1] * 5, [0.1, 0.2, 0.3, 0.4, 0.5]), "platt").collect()
    assert all(r["p"] > 0.99 and math.isfinite(r["p"]) for r in ones)
    parted = {r["score"]: r["p"] for r in calibrated(frame(spark, [0, 0, 1, 1], [0.1, 0.2, 0.8, 0.9]), "platt").collect()}
    assert parted[0.2] < 0.01 and parted[0.8] > 0.99


@pytest.mark.parametrize("points", [50_000, 3, 7])
def test_isotonic_equals_brute_force_whatever_the_ranges(spark, monkeypatch, points):
    monkeypatch.setattr(calibration, "RANGE_POINTS", points)
    rng = random.Random(points)
    for scores in ([round(rng.random(), 2) for _ in range(120)], [i / 60 for i in range(60)]):
        for flip in (False, True):
            labels = [int(rng.random() < (1 - s if flip else s)) for s in scores]
            got = {r["score"]: r["p"] for r in calibrated(frame(spark, labels, scores), "isotonic").collect()}
            want = least_squares(labels, scores)
            assert got.keys() == want.keys() and all(abs(got[x] - want[x]) < 1e-12 for x in want)
            means = [r["p"] for r in isotonic(frame(spark, labels, scores)).orderBy("x").collect()]
            assert all(a < b for a, b in zip(means, means[1:], strict=False))


def test_isotonic_ties_one_class_nulls_and_no_rows(spark):
    assert [tuple(r) for r in isotonic(frame(spark, [0, 1, 1, 0], [0.5, 0.5, 0.5, 0.2])).orderBy("x").collect()] == [(0.2, 1, 0.0), (0.5, 3, 2 / 3)]
    assert [tuple(r) for r in isotonic(frame(spark, [1, 1], [0.3, -0.0])).collect()] == [(0.0, 2, 1.0)]
    assert isotonic(frame(spark, [], [])).count() == 0
    rows = frame(spark, [1, None, 0, 1], [0.9, 0.1, None, math.nan])
    assert [tuple(r) for r in isotonic(rows).collect()] == [(0.9, 1, 1.0)]
    got = {r["id"]: r["p"] for r in calibrated(rows, "isotonic").collect()}
    assert got == {0: 1.0, 1: 1.0, 2: None, 3: 1.0}  # below the first step its value holds; NaN is above all numbers


def test_choice(spark):
    rows = frame(spark, [0, 1], [0.2, 0.9])
    assert [r["p"] for r in calibrated(rows, "none").orderBy("id").collect()] == [0.2, 0.9]
    assert calibrated(rows, "identity").columns == [*rows.columns, "p"]
    with pytest.raises(ValueError, match="unknown calibration"):
        calibrated(rows, "beta")


def test_last_at_or_before(spark):
    rng = random.Random(1)
    xs = sorted({round(rng.random(), 3) for _ in range(300)})
    at = sorted({round(rng.random(), 3) for _ in range(40)})
    points, model = spark.createDataFrame([(x,) for x in xs], "x double"), spark.createDataFrame([(x, x * 2) for x in at], "x double, v double")
    for n in (1, 16, 200):
        got = {r["x"]: r["v"] for r in steps.last_at_or_before(points, model, "v", n).collect()}
        assert got == {x: 2 * max([a for a in at if a <= x], default=at[0]) for x in xs}
    assert {r["v"] for r in steps.last_at_or_before(points, model.limit(0), "v").collect()} == {None}
