"""Genomic text formats, as lines of spark.read.text."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def vcf_calls(lines: DataFrame) -> DataFrame:
    """Variant calls of a VCF file's lines (column value): genotype and depth are found by name in FORMAT.

    Header lines and lines of fewer than ten columns are left out.
    """
    cells = lines.where(~F.col("value").startswith("#")).select(F.split("value", "\t").alias("c")).where(F.size("c") >= 10)
    part = lambda name: F.try_element_at(F.split(F.col("c")[9], ":"), F.array_position(F.split(F.col("c")[8], ":"), name).cast("int"))
    known = F.array_contains(F.split(F.col("c")[8], ":"), "DP")
    return cells.select(
        F.col("c")[0].alias("chrom"), F.col("c")[1].try_cast("long").alias("pos"), F.col("c")[3].alias("ref"), F.col("c")[4].alias("alt"), F.col("c")[5].try_cast("double").alias("qual"),
        F.when(F.array_contains(F.split(F.col("c")[8], ":"), "GT"), part("GT")).alias("genotype"), F.when(known, part("DP")).try_cast("int").alias("depth"),
    )


def bed_positions(lines: DataFrame) -> DataFrame:
    """(chrom, pos) for each position of a BED file's ranges, ends included; other lines are left out."""
    cells = lines.select(F.split("value", "\t").alias("c")).where(F.size("c") >= 3)
    ranges = cells.select(F.col("c")[0].alias("chrom"), F.col("c")[1].try_cast("long").alias("a"), F.col("c")[2].try_cast("long").alias("b")).where("a <= b")
    return ranges.select("chrom", F.explode(F.sequence("a", "b")).alias("pos"))
