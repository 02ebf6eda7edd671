"""Normalisation, tests, drift and summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..streaming import limits


def benjamini_hochberg(tests: DataFrame, family: list[str]) -> DataFrame:
    """tests (.., p) with fdr: p * m / rank, made monotone from the largest p down; each family of m tests alone."""
    w = W.partitionBy(*family)
    ranked = tests.withColumn("raw", F.col("p") * F.count("*").over(w) / F.rank().over(w.orderBy("p")))
    down = w.orderBy(F.desc("p")).rangeBetween(W.unboundedPreceding, 0)
    return ranked.withColumn("fdr", F.least(F.lit(1.0), F.min("raw").over(down))).drop("raw")


def scaled_rows(df: DataFrame, key: list[str], columns: list[str], total: float = 1e6) -> DataFrame:
    """df with its columns scaled to sum up to total in each row, as log2(x + 1); a row that sums up to 0 has zeros."""
    whole = sum((F.col(c) for c in columns), F.lit(0.0))
    return df.select(*key, *(F.log2(F.coalesce(F.col(c) * total / F.nullif(whole, F.lit(0.0)), F.lit(0.0)) + 1).alias(c) for c in columns))


def column_z(df: DataFrame, key: list[str], columns: list[str]) -> DataFrame:
    """df with each column less its mean, over its population deviation + 1e-9."""
    stats = df.agg(*(f(c).alias(f"{k}_{c}") for c in columns for k, f in (("m", F.avg), ("d", F.stddev_pop))))  # one row
    return df.join(F.broadcast(stats)).select(*key, *(((F.col(c) - F.col(f"m_{c}")) / (F.col(f"d_{c}") + 1e-9)).alias(c) for c in columns))


def severity(x: Column) -> Column:
    """none, low, medium, high or critical by 0.1, 0.25, 0.5 and 0.75."""
    return F.when(x >= 0.75, "critical").when(x >= 0.5, "high").when(x >= 0.25, "medium").when(x >= 0.1, "low").otherwise("none")


def prediction_drift(baseline: DataFrame, current: DataFrame, column: str) -> DataFrame:
    """(shift, quartiles, drift): the mean's shift in baseline deviations, the mean change of quartiles, and both together."""
    stats = lambda df, s: df.agg(F.avg(column).alias(f"m{s}"), F.stddev_pop(column).alias(f"d{s}"), F.percentile(column, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75))).alias(f"q{s}"))
    both = stats(baseline, 0).join(F.broadcast(stats(current, 1)))  # a row each
    shift = F.abs(F.col("m1") - F.col("m0")) / (F.col("d0") + 1e-8)
    quartiles = F.aggregate(F.zip_with("q0", "q1", lambda a, b: F.abs(a - b)), F.lit(0.0), lambda s, x: s + x) / 3
    return both.select(shift.alias("shift"), quartiles.alias("quartiles"), (shift + quartiles).alias("drift"))


def top_change(series: DataFrame, n: int) -> DataFrame:
    """(key, idx, change): the n largest absolute changes of each key's series (key, idx, value), earlier ones first if equal."""
    w = W.partitionBy("key")
    changes = series.select("key", "idx", F.abs(F.col("value") - F.lag("value").over(w.orderBy("idx"))).alias("change")).where("change is not null")
    return changes.withColumn("r", F.row_number().over(w.orderBy(F.desc("change"), "idx"))).where(F.col("r") <= n).drop("r")


def budget_fold(spends: DataFrame, budget: float) -> DataFrame:
    """(key, accepted, spent): spends (key, idx, epsilon) in order; one that would pass the budget is turned down and costs nothing.

    What is accepted depends on what was before, so this is a fold over a key's ordered spends, in the JVM.
    """
    ordered = spends.groupBy("key").agg(F.transform(F.sort_array(F.collect_list(F.struct("idx", "epsilon"))), lambda x: x["epsilon"]).alias("e"))
    start = F.struct(F.lit(0).alias("accepted"), F.lit(0.0).alias("spent"))
    fits = lambda s, x: s["spent"] + x <= budget + 1e-9
    step = lambda s, x: F.struct((s["accepted"] + fits(s, x).cast("int")).alias("accepted"), F.when(fits(s, x), s["spent"] + x).otherwise(s["spent"]).alias("spent"))
    return ordered.select("key", F.aggregate("e", start, step).alias("s")).select("key", "s.accepted", "s.spent")


def cooled(alerts: DataFrame, seconds: int) -> DataFrame:
    """(key, emitted): how many alerts (key, at in seconds) go out if each silences its key's others for some seconds; a fold, as silence counts from what went out."""
    due = lambda state, at, _: ((at,), (True,)) if state[0] is None or at - state[0] >= seconds else (state, None)
    rule = limits.Rule((None,), "last long", "sent boolean", due, 0)
    sent = limits.folded(alerts.select("key", "at", F.col("at").alias("id")), rule)
    return sent.groupBy("key").agg(F.count("*").cast("int").alias("emitted"))
