"""Column names, types and required fields of tables as they come in."""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SYNONYMS = {"chromosome": "chrom", "position": "pos", "sample": "sample_id"}


def standardized(df: DataFrame, synonyms: Mapping[str, str] = SYNONYMS) -> DataFrame:
    """df with names stripped, lower-cased and renamed from synonyms."""
    names = [c.strip().lower() for c in df.columns]
    return df.toDF(*(synonyms.get(c, c) for c in names))


def coerced(df: DataFrame, types: Mapping[str, str]) -> DataFrame:
    """df with the columns of types cast to them; what can't be cast becomes null, and missing columns are ignored."""
    return df.withColumns({c: F.col(c).try_cast(t) for c, t in types.items() if c in df.columns})


def first_missing(fields: Mapping[str, Column]) -> Column:
    """The name of the first field that is null, in their order; null if none is."""
    return F.coalesce(*(F.when(value.isNull(), F.lit(name)) for name, value in fields.items()))


def structure_rules(df: DataFrame, required: Iterable[str]) -> DataFrame:
    """(column_name, rule, violations): required columns that aren't there, or of which every value is null, in one pass."""
    required = list(required)
    there = [c for c in required if c in df.columns]
    counts = df.agg(*(F.count(c).alias(c) for c in there)) if there else df.sparkSession.range(1)
    cells = [F.struct(F.lit(c).alias("column_name"), F.lit("all_null").alias("rule"), (F.col(c) == 0).cast("long").alias("violations")) for c in there]
    cells += [F.struct(F.lit(c).alias("column_name"), F.lit("missing_column").alias("rule"), F.lit(1).cast("long").alias("violations")) for c in required if c not in df.columns]
    return counts.select(F.explode(F.array(*cells)).alias("x")).select("x.*").where("violations > 0")


def positive(value: Column, digits: int = 1) -> Column:
    """value rounded, or null unless it is above 0, so that compact records leave it out."""
    return F.when(value > 0, F.round(value, digits))


def with_ratio(df: DataFrame, key: str, name: str, weight: Column, height: Column) -> DataFrame:
    """(key, measure, value): weight / height ** 2 to one digit, as a further measurement; nothing where height is 0 or null.

    Tenths are rounded as doubles, as SQL engines do: F.round goes by the shortest decimal, and 27.549999999999997 is 275.5 tenths.
    """
    return df.where(height > 0).select(key, F.lit(name).alias("measure"), (F.round(weight / (height * height) * 10) / 10).alias("value"))
