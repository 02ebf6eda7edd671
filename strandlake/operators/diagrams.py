"""Distances of persistence diagrams."""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .steps import Steps


def _covers(near: list[np.ndarray], wanted: np.ndarray, right: int) -> bool:
    """Whether all wanted rows can be matched to distinct columns among their near ones: Hopcroft and Karp's layered search, without recursion."""
    to, of = {int(u): -1 for u in wanted}, np.full(right, -1)
    while True:
        layer, queue, free = {u: 0 for u in to if to[u] < 0}, deque(u for u in to if to[u] < 0), False
        if not queue:
            return True
        while queue:
            u = queue.popleft()
            for v in near[u]:
                if of[v] < 0:
                    free = True
                elif of[v] not in layer:
                    layer[of[v]] = layer[u] + 1
                    queue.append(of[v])
        if not free:
            return False
        for root in [u for u in to if to[u] < 0]:
            path, at = [root], {u: 0 for u in layer}
            while path:
                u = path[-1]
                if at[u] == len(near[u]):
                    del layer[u]  # leads nowhere in this round
                    path.pop()
                    if path:
                        at[path[-1]] += 1
                    continue
                v = near[u][at[u]]
                if of[v] < 0:
                    for w in reversed(path):  # turn the path around
                        v = near[w][at[w]]
                        of[v], to[w] = w, v
                    break
                if layer.get(of[v]) == layer[u] + 1:
                    path.append(of[v])
                else:
                    at[u] += 1


def bottleneck(a: np.ndarray, b: np.ndarray) -> float:
    """The least t at which the points (birth, death) of a and b can be matched one to one within t in both coordinates; points within t of the diagonal may go there instead.

    A matching that covers the far points of a and one that covers those of b together give one that covers both, so each side
    is asked for itself. The answer is one of the distances, and is found by bisection over them.
    """
    far_a, far_b = (a[:, 1] - a[:, 0]) / 2, (b[:, 1] - b[:, 0]) / 2
    apart = np.abs(a[:, None, :] - b[None, :, :]).max(2)
    steps = np.unique(np.concatenate([[0.0], apart.ravel(), far_a, far_b]))
    low, high = 0, len(steps) - 1
    while low < high:
        middle = (low + high) // 2
        t, close = steps[middle], apart <= steps[middle]
        fits = _covers([np.flatnonzero(x) for x in close], np.flatnonzero(far_a > t), len(b)) and _covers([np.flatnonzero(x) for x in close.T], np.flatnonzero(far_b > t), len(a))
        low, high = (low, middle) if fits else (middle + 1, high)
    return float(steps[low])


def _distances(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = []
        for i in range(batch.num_rows):
            sides = [np.array([(p["birth"], p["death"]) for p in batch.column(c)[i].as_py() or ()], float).reshape(-1, 2) for c in (2, 3)]
            out.append(bottleneck(*sides))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.float64())], ["a", "b", "distance"])


def _by_rank(pairs: DataFrame, points: DataFrame) -> DataFrame:
    """(a, b, x, y): the values of points (diagram, value) of both diagrams of each pair, largest first, the i-th with the i-th; null where one has fewer."""
    ranked = points.withColumn("i", F.row_number().over(W.partitionBy("diagram").orderBy(F.desc("value"))))
    side = lambda c, x, y: pairs.join(ranked.withColumnRenamed("diagram", c), c).select("a", "b", "i", F.col("value").alias(x), F.lit(None).cast("double").alias(y))
    both = side("a", "x", "y").unionByName(side("b", "y", "x"))
    return both.groupBy("a", "b", "i").agg(F.max("x").alias("x"), F.max("y").alias("y"))


def bottleneck_distances(diagrams: DataFrame, pairs: DataFrame) -> DataFrame:
    """diagrams (diagram, birth, death) and pairs (a, b) of their names to (a, b, distance).

    A null death is infinite: such points are matched in order of birth among themselves, and two diagrams with different numbers of them are
    infinitely far apart. A null birth is no point; a diagram without rows is empty.

    Where all finite points of a pair are born at one time, as components are, the longest of both match, then the next ones, and so on: were
    the i-th too far apart to match and one too long for the diagonal, i longer ones would have i - 1 partners. That is a join by rank, in work
    that grows with the points. Any other pair is packed into one row and searched by a task whose memory grows with the product of its numbers of points.
    """
    point = diagrams.select("diagram", F.col("birth").cast("double").alias("birth"), F.coalesce(F.col("death").cast("double"), F.lit(float("inf"))).alias("death")).where("birth is not null")
    point = Steps(diagrams.sparkSession).written(point, "points")  # read by each part below
    lasts = F.col("death") == float("inf")
    known = point.groupBy("diagram").agg(F.min(F.when(~lasts, F.col("birth"))).alias("low"), F.max(F.when(~lasts, F.col("birth"))).alias("high"), F.count_if(lasts).alias("lasting"))
    side = lambda c: known.select(F.col("diagram").alias(c), *(F.col(x).alias(f"{x}_{c}") for x in ("low", "high", "lasting")))
    asked = pairs.select("a", "b").distinct().join(side("a"), "a", "left").join(side("b"), "b", "left")
    level = F.coalesce(F.least("low_a", "low_b") == F.greatest("high_a", "high_b"), F.lit(True))
    asked = asked.select("a", "b", level.alias("level"), (F.coalesce("lasting_a", F.lit(0)) == F.coalesce("lasting_b", F.lit(0))).alias("alike"))
    finite, lasting = point.where(~lasts), point.where(lasts)
    lengths = _by_rank(asked.where("level").select("a", "b"), finite.select("diagram", (F.col("death") - F.col("birth")).alias("value")))
    x, y = F.coalesce("x", F.lit(0.0)), F.coalesce("y", F.lit(0.0))
    parts = lengths.groupBy("a", "b").agg(F.max(F.greatest(F.lit(0.0), F.least(F.abs(x - y), F.greatest(x, y) / 2))).alias("distance"))
    births = _by_rank(asked.where("alike").select("a", "b"), lasting.select("diagram", F.col("birth").alias("value")))
    parts = parts.unionByName(births.groupBy("a", "b").agg(F.max(F.abs(F.col("x") - F.col("y"))).alias("distance")))
    packed = finite.groupBy("diagram").agg(F.collect_list(F.struct("birth", "death")).alias("points"))
    points = lambda c: packed.select(F.col("diagram").alias(c), F.col("points").alias(f"points_{c}"))
    kinds = {f.name: f.dataType.simpleString() for f in pairs.schema}
    other = asked.where("not level").join(points("a"), "a", "left").join(points("b"), "b", "left").select("a", "b", "points_a", "points_b")
    parts = parts.unionByName(other.mapInArrow(_distances, f"a {kinds['a']}, b {kinds['b']}, distance double"))
    parts = parts.unionByName(asked.where("not alike").select("a", "b", F.lit(float("inf")).alias("distance")))
    whole = parts.groupBy(F.col("a").alias("_a"), F.col("b").alias("_b")).agg(F.max("distance").alias("distance"))
    both = pairs.select("a", "b").join(whole, F.col("a").eqNullSafe(F.col("_a")) & F.col("b").eqNullSafe(F.col("_b")), "left")
    return both.select("a", "b", F.coalesce("distance", F.lit(0.0)).alias("distance"))
