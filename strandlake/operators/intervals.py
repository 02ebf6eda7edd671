"""Lookups by position and by interval."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def overlaps(a: DataFrame, b: DataFrame, width: int) -> DataFrame:
    """Pairs of half-open intervals (id, chrom, start, end) that overlap, as (id_a, id_b), each once.

    Intervals meet in bins of width positions; a pair counts in the bin where the later of both starts is, so
    none comes twice and no distinct is needed.
    """
    binned = lambda x, s: x.where("start < end").select(F.col("chrom"), *(F.col(c).alias(f"{c}_{s}") for c in ("id", "start", "end")), F.explode(F.expr(f"sequence(start div {width}, (end - 1) div {width})")).alias("bin"))
    met = binned(a, "a").join(binned(b, "b"), ["chrom", "bin"]).where("start_a < end_b and end_a > start_b")
    return met.where(F.expr(f"bin = greatest(start_a, start_b) div {width}")).select("id_a", "id_b")


def points_in(points: DataFrame, regions: DataFrame, width: int) -> DataFrame:
    """(region, id) for points (id, chrom, pos) in regions (region, chrom, first, last), both ends included."""
    spread = regions.where("first <= last").withColumn("bin", F.explode(F.expr(f"sequence(first div {width}, last div {width})")))
    return points.withColumn("bin", F.expr(f"pos div {width}")).join(spread, ["chrom", "bin"]).where("pos between first and last").select("region", "id")
