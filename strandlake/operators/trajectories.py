"""How the vectors of a series move: drift from one to the next, sustained drift, and the shape of the way."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import vectors as V
from . import sequences


def drift_flags(rows: DataFrame, by: str, order: str, vector: str, threshold: float = 0.15, window: int = 5, sustained: float = 0.8) -> DataFrame:
    """(rows' columns, drift, flagged, rolling, sustained) for each row but the first of its series.

    drift is 1 - cosine to the row before; flagged where it is above threshold. rolling is the mean of the last window drifts, null while
    there are fewer; sustained where it is above sustained * threshold. No task holds a whole series: ranges of the order
    pass on their last rows. A null vector has no drift, nor has the row after it; such rows are left out, and windows go over what is left.
    Rows of equal order go by their vectors. An empty table gives no rows.
    """
    moved = sequences.beside_previous(rows, by, order, vector, "vector_before").where(F.col("vector_before").isNotNull() & F.col(vector).isNotNull())
    moved = moved.withColumn("drift", 1 - V.cosine(F.col(vector), F.col("vector_before"))).drop("vector_before")

    def made(w):
        w = w.rowsBetween(1 - window, 0)
        return {"rolling": F.when(F.count("drift").over(w) == window, F.avg("drift").over(w))}

    out = sequences.over_last(moved, by, order, ["drift"], window - 1, made) if window > 1 else moved.withColumn("rolling", F.col("drift"))
    return out.withColumn("flagged", F.col("drift") > threshold).withColumn("sustained", F.col("rolling") > sustained * threshold)


def shape(rows: DataFrame, by: str, order: str, vector: str) -> DataFrame:
    """(by, n, path, direct, smoothness, efficiency, avg_curvature, max_curvature) of each series of vectors.

    path is the length of all steps and direct that from first to last; smoothness is their ratio, efficiency its inverse; curvature is the angle between
    a step and the one before it, in radians. Fewer than three vectors: smoothness 1, curvature 0. Null vectors are left out. Rows of equal
    order go by their vectors. Series are never gathered: each row meets the two before it, and what it adds is summed up by partial aggregation.
    """
    given = rows.where(F.col(vector).isNotNull()).select(F.col(by).alias("of"), F.col(order).alias("o"), F.col(vector).alias("v"))
    met = sequences.over_last(given, "of", "o", ["v"], 2, lambda w: {"p": F.lag("v").over(w), "q": F.lag("v", 2).over(w)})
    step = lambda a, b: F.zip_with(a, b, lambda x, y: x.cast("double") - y.cast("double"))
    met = met.select("of", "o", "v", step(F.col("v"), F.col("p")).alias("s"), step(F.col("p"), F.col("q")).alias("t"))
    turn = V.dot(F.col("t"), F.col("s")) / (V.norm(F.col("t")) * V.norm(F.col("s")) + 1e-8)
    angle = F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), turn)))
    each = met.select("of", F.struct("o", "v").alias("at"), F.coalesce(V.norm(F.col("s")), F.lit(0.0)).alias("length"), F.when(F.col("t").isNotNull(), angle).alias("angle"))
    by_series = each.groupBy("of").agg(F.count("*").alias("n"), F.sum("length").alias("path"), V.euclidean(F.max("at")["v"], F.min("at")["v"]).alias("direct"), F.avg("angle").alias("mean_angle"), F.max("angle").alias("top_angle"))
    few = F.col("n") < 3
    return by_series.select(
        F.col("of").alias(by), "n", "path", "direct",
        F.when(few, 1.0).otherwise(F.col("path") / (F.col("direct") + 1e-8)).alias("smoothness"),
        (F.col("direct") / (F.col("path") + 1e-8)).alias("efficiency"),
        F.when(few, 0.0).otherwise(F.col("mean_angle")).alias("avg_curvature"),
        F.when(few, 0.0).otherwise(F.col("top_angle")).alias("max_curvature"),
    )
