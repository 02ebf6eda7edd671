"""Series: z-scores, runs of anomalies, drift."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def zscores(series: DataFrame) -> DataFrame:
    """Series (key, idx, value) with z: the distance to the key's mean in population deviations; null without spread."""
    stats = series.groupBy("key").agg(F.avg("value").alias("m"), F.stddev_pop("value").alias("sd"))
    return series.join(stats, "key").select("key", "idx", "value", ((F.col("value") - F.col("m")) / F.nullif(F.col("sd"), F.lit(0.0))).alias("z"))


def islands(flagged: DataFrame, least: int) -> DataFrame:
    """(key, start, end, length) of runs of flagged rows (key, idx, flag) of at least least rows, ends exclusive."""
    runs = flagged.where("flag").withColumn("run", F.col("idx") - F.row_number().over(W.partitionBy("key").orderBy("idx")))
    return runs.groupBy("key", "run").agg(F.min("idx").alias("start"), (F.max("idx") + 1).alias("end"), F.count("*").alias("length")).where(F.col("length") >= least).select("key", "start", "end", "length")


def covariate_drift(baseline: DataFrame, current: DataFrame, features: list[str]) -> DataFrame:
    """(feature, drift): the shift of the mean and the log ratio of deviations, against the baseline."""
    stats = lambda df, s: df.agg(*(f(c).alias(f"{k}{s}_{c}") for c in features for k, f in (("m", F.avg), ("d", F.stddev_pop))))
    both = stats(baseline, 0).join(stats(current, 1))  # a row each
    drift = lambda c: F.abs(F.col(f"m1_{c}") - F.col(f"m0_{c}")) / (F.col(f"d0_{c}") + 1e-8) + F.abs(F.ln(F.col(f"d1_{c}") / (F.col(f"d0_{c}") + 1e-8)))
    return both.select(F.inline(F.array(*(F.struct(F.lit(c).alias("feature"), drift(c).alias("drift")) for c in features))))
