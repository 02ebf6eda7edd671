"""Aggregation of vectors over clients, position by position."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import vectors


def positions(updates: DataFrame) -> DataFrame:
    """Updates (client, vector, n) as (client, n, pos, w)."""
    return updates.select("client", "n", F.posexplode("vector").alias("pos", "w")).withColumn("w", F.col("w").cast("double"))


def weighted_mean(updates: DataFrame) -> DataFrame:
    """(pos, value): the mean of each position, weighted by n."""
    return positions(updates).groupBy("pos").agg((F.sum(F.col("w") * F.col("n")) / F.sum("n")).alias("value"))


def trimmed_mean(updates: DataFrame, share: float = 0.2) -> DataFrame:
    """(pos, value): the mean of each position without its floor(share * n) lowest and highest values."""
    w = W.partitionBy("pos")
    ranked = positions(updates).select("pos", "w", F.row_number().over(w.orderBy("w", "client")).alias("r"), F.count("*").over(w).alias("c"))
    cut = F.floor(F.col("c") * share)
    return ranked.where((F.col("r") > cut) & (F.col("r") <= F.col("c") - cut)).groupBy("pos").agg(F.avg("w").alias("value"))


def bundle(updates: DataFrame, how: str = "l2") -> DataFrame:
    """(pos, value): the sum of all vectors at length one (l2), its signs with ties up (sign) or at 0 (signum), or the parity of positive ones (xor)."""
    sums = positions(updates).groupBy("pos").agg(F.sum("w").alias("s"), F.count_if(F.col("w") > 0).alias("p"))
    if how == "l2":
        length = F.sqrt(F.sum(F.col("s") * F.col("s")).over(W.partitionBy()))
        return sums.select("pos", F.when(length > 0, F.col("s") / length).otherwise(F.col("s")).alias("value"))
    value = {"sign": F.when(F.col("s") >= 0, 1).otherwise(-1), "signum": F.signum("s").cast("int"), "xor": (F.col("p") % 2 * 2 - 1).cast("int")}[how]
    return sums.select("pos", value.alias("value"))


def clipped(updates: DataFrame, length: float) -> DataFrame:
    """updates with each vector scaled down to length at most."""
    own = vectors.norm(F.col("vector"))
    factor = F.least(F.lit(1.0), length / F.nullif(own, F.lit(0.0)))
    return updates.withColumn("_factor", F.coalesce(factor, F.lit(1.0))).withColumn("vector", F.transform("vector", lambda x: x.cast("double") * F.col("_factor"))).drop("_factor")


def reputation(updates: DataFrame, start: float = 1.0, near: float = 2.0) -> DataFrame:
    """(client, reputation): start + 0.01, 1 at most, for an update nearer than near to the mean of all; else start - 0.05, 0 at least."""
    cells = positions(updates)
    mean = cells.groupBy("pos").agg(F.avg("w").alias("m"))
    far = cells.join(F.broadcast(mean), "pos").groupBy("client").agg(F.sqrt(F.sum((F.col("w") - F.col("m")) ** 2)).alias("d"))  # a row for each position
    return far.select("client", F.when(F.col("d") < near, F.lit(min(1.0, round(start + 0.01, 9)))).otherwise(F.lit(max(0.0, round(start - 0.05, 9)))).alias("reputation"))


def masked_sums(updates: DataFrame, bucket: int = 1000, seed: int = 31) -> DataFrame:
    """(pos, value): the sum of each position, of updates (client, vector, n) that are masked before they are added up.

    Clients stand in rings of about `bucket`, dealt by a hash. Each adds a mask that it shares with the next one of its ring and takes away
    the one that it shares with the one before, so all masks of a ring cancel, whatever ids are missing; a client alone in its ring has
    itself on both sides. Client ids are distinct.
    """
    rings = -(-max(updates.count(), 1) // bucket)
    ring = W.partitionBy("ring").orderBy("client")
    placed = updates.withColumn("ring", F.pmod(F.xxhash64("client"), F.lit(rings)))
    whole = ring.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    placed = placed.withColumn("before", F.coalesce(F.lag("client").over(ring), F.last("client").over(whole)))
    mask = lambda a: F.pmod(F.xxhash64(F.lit(seed), a, "pos"), F.lit(1000)) / 1000.0
    cells = placed.select("client", "before", F.posexplode("vector").alias("pos", "w"))
    hidden = F.col("w").cast("double") + mask(F.col("client")) - mask(F.col("before"))
    return cells.select("pos", hidden.alias("m")).groupBy("pos").agg(F.sum("m").alias("value"))
