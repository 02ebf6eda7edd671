"""Data contracts and profiles: all rules of a table in one pass over it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def column_rules(df: DataFrame, rules: dict[str, dict]) -> DataFrame:
    """(column_name, rule, violations) for rules allow_null, regex (of whole strings), min and max; nulls pass all but the first."""
    counts = []
    for column, rule in rules.items():
        c = F.col(column)
        if rule.get("allow_null") is False:
            counts.append((column, "nulls", c.isNull()))
        if "regex" in rule:
            counts.append((column, "regex", ~c.cast("string").rlike(f"^(?:{rule['regex']})$")))
        if "min" in rule:
            counts.append((column, "min", c < rule["min"]))
        if "max" in rule:
            counts.append((column, "max", c > rule["max"]))
    one = df.agg(*(F.count_if(bad).alias(f"r{i}") for i, (_, _, bad) in enumerate(counts)))
    rows = F.array(*(F.struct(F.lit(c).alias("column_name"), F.lit(r).alias("rule"), F.col(f"r{i}").alias("violations")) for i, (c, r, _) in enumerate(counts)))
    return one.select(F.inline(rows))


def repeated_rows(df: DataFrame, keys: list[str], drop_nulls: bool = False) -> DataFrame:
    """(violations): rows whose key another row has too, all of them counted. Nulls equal nulls unless dropped."""
    some = df.dropna(subset=keys) if drop_nulls else df
    groups = some.groupBy(*keys).count().where("count > 1")
    return groups.agg(F.coalesce(F.sum("count"), F.lit(0)).alias("violations"))


def profile(df: DataFrame, columns: list[str]) -> DataFrame:
    """(column_name, n_rows, n_null, n_distinct, min_value, max_value) of numeric columns, in one pass."""
    one = df.agg(F.count("*").alias("n"), *(f(c).alias(f"{k}_{c}") for c in columns for k, f in (("nulls", lambda c: F.count_if(F.col(c).isNull())), ("distinct", F.countDistinct), ("min", F.min), ("max", F.max))))
    row = lambda c: F.struct(F.lit(c).alias("column_name"), F.col("n").alias("n_rows"), F.col(f"nulls_{c}").alias("n_null"), F.col(f"distinct_{c}").alias("n_distinct"), F.col(f"min_{c}").cast("double").alias("min_value"), F.col(f"max_{c}").cast("double").alias("max_value"))
    return one.select(F.inline(F.array(*(row(c) for c in columns))))
