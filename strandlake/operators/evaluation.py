"""Evaluation of scores against labels. All take a DataFrame (id, label 0/1, score)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


#: Ranges of scores in which running sums are taken, each alone.
CELLS = 64


def running(rows: DataFrame, sums: list[str], order: list) -> DataFrame:
    """rows (score, ..) with upto_x for each x of sums: its sum over all rows of a score up to this one in the order, which goes by score.

    Scores are cut into CELLS ranges by their approximate quantiles. Sums of whole ranges come first, then
    those within one range, so no task puts all rows in order. The driver sees the cuts only.
    """
    cuts = sorted(set(rows.approxQuantile("score", [i / CELLS for i in range(1, CELLS)], 0.005)))
    cell = F.size(F.filter(F.array(*(F.lit(c) for c in cuts)), lambda c: c < F.col("score"))) if cuts else F.lit(0)
    rows = rows.withColumn("cell", cell)
    over = W.orderBy("cell").rowsBetween(W.unboundedPreceding, -1)
    before = rows.groupBy("cell").agg(*(F.sum(x).alias(x) for x in sums)).select("cell", *(F.coalesce(F.sum(x).over(over), F.lit(0)).alias(f"before_{x}") for x in sums))
    within = W.partitionBy("cell").orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    placed = rows.select("*", *(F.sum(x).over(within).alias(f"within_{x}") for x in sums)).join(F.broadcast(before), "cell")  # CELLS rows at most
    return placed.select(*rows.columns, *((F.col(f"before_{x}") + F.col(f"within_{x}")).alias(f"upto_{x}") for x in sums))


def by_score(scored: DataFrame) -> DataFrame:
    return scored.groupBy(F.col("score").cast("double").alias("score")).agg(F.sum("label").alias("pos"), F.sum(1 - F.col("label")).alias("neg"))


def auroc(scored: DataFrame) -> DataFrame:
    """(auroc) by ranks, ties at their average; null if a class is missing."""
    by = running(by_score(scored), ["neg"], ["score"])
    return by.withColumn("wins", F.col("pos") * (F.col("upto_neg") - F.col("neg") / 2)).agg((F.sum("wins") / F.nullif(F.sum("pos") * F.sum("neg"), F.lit(0))).alias("auroc"))


def average_precision(scored: DataFrame) -> DataFrame:
    """(average_precision): the sum of precision at each positive, by score descending, then id."""
    rows = scored.select((-F.col("score")).cast("double").alias("score"), "id", "label", F.lit(1).alias("one"))
    ranked = running(rows, ["label", "one"], ["score", "id"])
    return ranked.agg((F.sum(F.when(F.col("label") == 1, F.col("upto_label") / F.col("upto_one"))) / F.sum("label")).alias("average_precision"))


def calibration(scored: DataFrame, bins: int = 10) -> DataFrame:
    """(ece, mce) over bins that are closed on the right."""
    at = F.least(F.greatest(F.ceil(F.col("score") * bins) - 1, F.lit(0)), F.lit(bins - 1))
    by = scored.groupBy(at.alias("bin")).agg(F.count("*").alias("n"), F.abs(F.avg("label") - F.avg("score")).alias("gap"))
    return by.agg((F.sum(F.col("n") * F.col("gap")) / F.sum("n")).alias("ece"), F.max("gap").alias("mce"))


def confusion(scored: DataFrame, threshold: float = 0.5) -> DataFrame:
    """(tp, fp, tn, fn, brier) at a threshold."""
    hit, true = F.col("score") >= threshold, F.col("label") == 1
    p = F.least(F.greatest("score", F.lit(1e-12)), F.lit(1 - 1e-12))
    return scored.agg(F.count_if(hit & true).alias("tp"), F.count_if(hit & ~true).alias("fp"), F.count_if(~hit & ~true).alias("tn"), F.count_if(~hit & true).alias("fn"), F.avg((p - F.col("label")) * (p - F.col("label"))).alias("brier"))


def youden(scored: DataFrame) -> DataFrame:
    """(threshold, j): the lowest score of highest sensitivity + specificity - 1."""
    by = running(by_score(scored).withColumn("score", -F.col("score")), ["pos", "neg"], ["score"])
    totals = by.agg(F.sum("pos").alias("all_pos"), F.sum("neg").alias("all_neg"))  # one row
    j = F.col("upto_pos") / F.col("all_pos") - F.col("upto_neg") / F.col("all_neg")
    return by.join(F.broadcast(totals)).select((-F.col("score")).alias("threshold"), F.round(j, 9).alias("j")).orderBy(F.desc("j"), "threshold").limit(1)


def log_loss(scored: DataFrame) -> DataFrame:
    """(logloss, accuracy) of probabilities, clipped off 0 and 1; predictions are 1 from 0.5 on."""
    p = F.least(F.greatest("score", F.lit(1e-12)), F.lit(1 - 1e-12))
    loss = -F.when(F.col("label") == 1, F.ln(p)).otherwise(F.ln(1 - p))
    return scored.agg(F.avg(loss).alias("logloss"), F.avg(((F.col("score") >= 0.5).cast("int") == F.col("label")).cast("int")).alias("accuracy"))


def rates(scored: DataFrame, threshold: float = 0.5) -> DataFrame:
    """(sensitivity, specificity, precision, f1, brier) at a threshold; empty denominators count as 1."""
    ratio = lambda a, b: a / F.greatest(F.lit(1), b)
    c = F.col
    out = confusion(scored, threshold).select("*", ratio(c("tp"), c("tp") + c("fn")).alias("sensitivity"), ratio(c("tn"), c("tn") + c("fp")).alias("specificity"), ratio(c("tp"), c("tp") + c("fp")).alias("precision"))
    f1 = 2 * c("precision") * c("sensitivity") / F.greatest(F.lit(1e-12), c("precision") + c("sensitivity"))
    return out.select("sensitivity", "specificity", "precision", f1.alias("f1"), "brier")
