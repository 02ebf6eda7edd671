"""Calibration: from scores to probabilities, fitted on labels. All take a DataFrame (label 0/1, score).

Both fits first group the rows by score, so each distinct score is one weighted point; rows with a null label or a null or
non-finite score take no part in a fit.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import evaluation
from .steps import Steps, cells_of, last_at_or_before

#: Points of a range whose violators one task pools.
RANGE_POINTS = 50_000


def points_of(scored: DataFrame) -> DataFrame:
    """(x, n, pos): the distinct scores, how many rows have each and how many of them are positive."""
    x = F.col("score").cast("double")
    known = scored.where(F.col("label").isNotNull() & x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return known.groupBy((x + 0.0).alias("x")).agg(F.count("*").alias("n"), F.sum(F.col("label").cast("double")).alias("pos"))


def platt(scored: DataFrame, most_rounds: int = 100, tolerance: float = 1e-8, ridge: float = 1e-6) -> tuple[float, float]:
    """(intercept, slope) of a logistic curve over the scores, by Newton's method with a small ridge.

    A round is one aggregate of five sums over the distinct scores, which is all the driver sees. With one class only, or classes
    that a threshold parts, the ridge keeps the fit finite and most_rounds ends it. No rows give (0, 0), so 0.5 for every score.
    """
    points = Steps(scored.sparkSession).written(points_of(scored), "points")
    a = b = 0.0
    for _ in range(most_rounds):
        p = 1 / (1 + F.exp(-(a + b * F.col("x"))))
        w, left, x = F.col("n") * (p * (1 - p) + 1e-12), F.col("pos") - F.col("n") * p, F.col("x")
        g0, g1, h00, h01, h11 = (v or 0.0 for v in points.agg(F.sum(left), F.sum(left * x), F.sum(w), F.sum(w * x), F.sum(w * x * x)).first())
        g0, g1, h00, h11 = g0 - ridge * a, g1 - ridge * b, h00 + ridge, h11 + ridge
        det = h00 * h11 - h01 * h01
        da, db = (h11 * g0 - h01 * g1) / det, (h00 * g1 - h01 * g0) / det
        a, b = a + da, b + db
        if math.hypot(da, db) < tolerance:
            break
    return a, b


def pooled(rows: Iterator[tuple[float, int, float]]) -> list[list]:
    """Blocks [x, n, pos] of sorted points: neighbours are pooled while an earlier one's mean isn't below a later one's."""
    stack: list[list] = []
    for x, n, pos in rows:
        stack.append([x, n, pos])
        while len(stack) > 1 and stack[-2][2] * stack[-1][1] >= stack[-1][2] * stack[-2][1]:
            _, n, pos = stack.pop()
            stack[-1][1] += n
            stack[-1][2] += pos
    return stack


def _pool(frame: pd.DataFrame) -> pd.DataFrame:
    own = frame.sort_values("x")
    return pd.DataFrame(pooled(own[["x", "n", "pos"]].itertuples(index=False, name=None)), columns=["x", "n", "pos"]).assign(cell=own["cell"].iloc[0])


def isotonic(scored: DataFrame) -> DataFrame:
    """(x, n, p): the steps of the best non-decreasing fit; a step holds from its x up to the next one's.

    Adjacent violators are pooled range by range, then across ranges: the blocks that are left are cut into ranges anew, with
    cuts half a range further, until no range ends above where the next one begins. A violation at a cut lies within a range
    of the next round, so each round pools some blocks and the last one none. No task sorts all scores.
    Equal scores are one point. One class gives one step, of 0 or 1; no rows give none.
    """
    steps = Steps(scored.sparkSession)
    blocks = steps.written(points_of(scored), "blocks")
    shift = 0.0
    while True:
        n = -(-blocks.count() // RANGE_POINTS)
        cell, _ = cells_of(blocks, "x", max(n, 1), shift)
        blocks = steps.written(blocks.select("x", "n", "pos").withColumn("cell", cell).groupBy("cell").applyInPandas(_pool, "x double, n long, pos double, cell int"), "blocks")
        mean = F.col("pos") / F.col("n")
        ends = blocks.groupBy("cell").agg(F.min_by(mean, "x").alias("low"), F.max_by(mean, "x").alias("high"))
        # one row for each RANGE_POINTS blocks
        if n <= 1 or ends.selectExpr("high >= lead(low) over (order by cell) as bad").where("bad").isEmpty():
            steps.drop_before_last("blocks")
            return blocks.select("x", "n", mean.alias("p"))
        shift = 0.5 - shift


def _isotonic_scores(scored: DataFrame) -> DataFrame:
    model = isotonic(scored)
    distinct = scored.where("score is not null").select((F.col("score").cast("double") + 0.0).alias("x")).distinct()
    found = last_at_or_before(distinct, model.select("x", "p"), "p")
    rows = scored.withColumn("_x", F.col("score").cast("double") + 0.0)
    return rows.join(found, rows["_x"] == found["x"], "left").drop("_x", "x")


def calibrated(scored: DataFrame, method: str = "platt") -> DataFrame:
    """scored with p, its scores as probabilities: by platt, isotonic, or none (the score itself, also called identity).

    A null score has a null p. Any further columns stay, but none may be named p, x or _x.
    """
    if method == "platt":
        a, b = platt(scored)
        return scored.withColumn("p", 1 / (1 + F.exp(-(a + b * F.col("score")))))
    if method == "isotonic":
        return _isotonic_scores(scored)
    if method in ("none", "identity"):
        return scored.withColumn("p", F.col("score").cast("double"))
    raise ValueError(f"unknown calibration: {method}")


def by_method(scored: DataFrame, methods: tuple[str, ...] = ("none", "platt", "isotonic"), bins: int = 10) -> DataFrame:
    """(method, brier, ece, mce) of each way to calibrate, on the rows that it was fitted on: what to choose by."""
    out = None
    for method in methods:
        p = calibrated(scored, method).select("label", F.col("p").alias("score"))
        one = evaluation.confusion(p).select(F.lit(method).alias("method"), "brier").join(F.broadcast(evaluation.calibration(p, bins)))  # a row each
        out = one if out is None else out.unionByName(one)
    return out
