"""Lookups of variants, genes, regions and populations, and the scores built on them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import intervals


def population_frequency(variants: DataFrame, frequencies: DataFrame, keys: list[str], population: str) -> DataFrame:
    """variants with frequency: that of the population in frequencies (keys, population, frequency), 0 where it isn't known."""
    own = frequencies.where(F.col("population") == population).select(*keys, "frequency")
    return variants.join(own, keys, "left").withColumn("frequency", F.coalesce("frequency", F.lit(0.0)))


def nodes_in_region(nodes: DataFrame, first: int, last: int, population: str) -> DataFrame:
    """nodes (pos, populations, ..) from first to last, both included, that the population has."""
    return nodes.where(F.col("pos").between(first, last) & F.array_contains("populations", population))


def gene_annotation(genes: DataFrame, variants: DataFrame, impacts: list[str], width: int) -> DataFrame:
    """(region, total, matching) for genes (region, chrom, first, last) over variants (id, chrom, pos): id is a struct with impact."""
    met = intervals.points_in(variants, genes, width)
    return met.groupBy("region").agg(F.count("*").alias("total"), F.count_if(F.col("id.impact").isin(impacts)).alias("matching"))


def edge_support(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """edges (a, b, ..) with pos_a and pos_b of their nodes (node, pos); edges with an unknown end go."""
    of = lambda side: nodes.select(F.col("node").alias(side), F.col("pos").alias(f"pos_{side}"))
    return edges.join(of("a"), "a").join(of("b"), "b")


def enrichment(pathways: DataFrame, detected: DataFrame) -> DataFrame:
    """(pathway, size, overlap, enrichment): which share of each pathway's members (pathway, member) was detected (member)."""
    hit = pathways.join(detected.select("member", F.lit(True).alias("hit")).distinct(), "member", "left")
    by = hit.groupBy("pathway").agg(F.count("*").alias("size"), F.count("hit").alias("overlap"))
    return by.withColumn("enrichment", F.col("overlap") / F.col("size"))


def log_odds_score(matches: DataFrame, key: str, odds: str) -> DataFrame:
    """(key, n, score, low, high): the sigmoid of ten times the mean log odds; 0.5 without a match; bounds at 1.96 * 0.1 / sqrt(n + 1)."""
    by = matches.groupBy(key).agg(F.count(odds).alias("n"), F.avg(F.ln(odds)).alias("m"))
    score = F.coalesce(1 / (1 + F.exp(-10 * F.col("m"))), F.lit(0.5))
    half = 1.96 * 0.1 / F.sqrt(F.col("n") + 1)
    return by.select(key, "n", score.alias("score"), F.greatest(F.lit(0.0), score - half).alias("low"), F.least(F.lit(1.0), score + half).alias("high"))


def chromosome(name: Column) -> Column:
    """chr1 to chr22, chrX, chrY, chrM or chrMT from a name with or without the prefix, in any case; else null."""
    bare = F.regexp_replace(F.upper(F.trim(name)), "^CHR", "")
    return F.when(bare.rlike("^([1-9]|1[0-9]|2[0-2]|X|Y|M|MT)$"), F.concat(F.lit("chr"), bare))


def homopolymer_share(sequence: Column, letters: str = "acgt", least: int = 3) -> Column:
    """The share of a sequence's characters that stand in runs of least or more of one letter; null for an empty one."""
    runs = F.regexp_extract_all(sequence, F.lit("(" + "|".join(f"{x}{{{least},}}" for x in letters) + ")"), F.lit(1))
    return F.nullif(F.aggregate(runs, F.lit(0), lambda n, x: n + F.length(x)), F.lit(-1)) / F.nullif(F.length(sequence), F.lit(0))


def first_label(scores: dict[str, Column], least: float = 0.5, default: str = "unknown") -> Column:
    """The label of the highest score, the first in order if equal; default if none is above least."""
    top = F.greatest(*scores.values())
    chosen = F.coalesce(*(F.when(value == top, F.lit(name)) for name, value in scores.items()))
    return F.when(top > least, chosen).otherwise(default)
