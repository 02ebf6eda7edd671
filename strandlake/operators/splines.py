"""Layers of splines: each output is the sum over all inputs of a spline of its own, through tanh.

A value has degree + 1 basis functions that aren't zero, so a layer is a sparse long table (row, input, knot, weight) joined with its
coefficients and added up per row and output.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Coefficients that are broadcast; a larger layer is joined by shuffle.
MOST_BROADCAST = 1_000_000


def basis(x: Column, knots: int = 10, degree: int = 3) -> Column:
    """The B-spline basis at x over evenly spaced knots from -1 to 1, as an array of (k, weight) with degree + 1 entries that sum to one.

    There are knots + degree - 1 functions: the knots go on beyond both ends, so the sum is one all over. x is clamped to -1 and 1. The
    weights follow the Cox-de Boor recursion, which over even knots needs only where x lies within its interval.
    """
    place = (F.least(F.greatest(x.cast("double"), F.lit(-1.0)), F.lit(1.0)) + 1.0) * ((knots - 1) / 2.0)
    first = F.least(F.floor(place), F.lit(knots - 2)).cast("int")

    def weights(u: Column) -> list[Column]:
        w = [F.lit(1.0)]
        for p in range(1, degree + 1):
            rise = lambda r: (u + (p - 1 - r)) / p  # noqa: B023, E731
            w = [(rise(r - 1) * w[r - 1] if r > 0 else F.lit(0.0)) + ((1 - rise(r)) * w[r] if r < p else F.lit(0.0)) for r in range(p + 1)]
        return w

    at = F.transform(F.array(F.struct(first.alias("m"), (place - first).alias("u"))), lambda c: F.array(*(F.struct((c["m"] + r).alias("k"), w.alias("weight")) for r, w in enumerate(weights(c["u"])))))
    return F.get(at, F.lit(0))


def spline_layer(vectors: DataFrame, coefficients: DataFrame, knots: int = 10, degree: int = 3) -> DataFrame:
    """vectors (id, vector) and coefficients (output, input, k, c) to (id, vector): tanh of the sums, one component for each output in order.

    Coefficients that are missing are 0; outputs are those that the coefficients name. A null component counts as 0 and adds its basis there; a null
    vector has no row. Ids are distinct.
    """
    cells = vectors.where("vector is not null").select("id", F.posexplode("vector").alias("input", "x"))
    sparse = cells.select("id", "input", F.explode(basis(F.coalesce("x", F.lit(0.0)), knots, degree)).alias("b")).select("id", "input", "b.k", "b.weight")
    few = coefficients.count() <= MOST_BROADCAST
    summed = sparse.join(F.broadcast(coefficients) if few else coefficients, ["input", "k"]).groupBy("id", "output").agg(F.sum(F.col("weight") * F.col("c")).alias("s"))
    return summed.groupBy("id").agg(F.transform(F.sort_array(F.collect_list(F.struct("output", F.tanh("s").alias("y")))), lambda o: o["y"]).alias("vector"))


def spline_encode(vectors: DataFrame, layers: Sequence[DataFrame], knots: int = 10, degree: int = 3) -> DataFrame:
    """vectors through all layers, one after the other."""
    for layer in layers:
        vectors = spline_layer(vectors, layer, knots, degree)
    return vectors
