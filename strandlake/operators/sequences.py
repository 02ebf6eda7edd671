"""Neighbours in a series, whose series may be few and long: no task holds a whole one."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, WindowSpec
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Ranges of the order into which each series is cut.
RANGES = 64


def _ranged(rows: DataFrame, order: str, ranges: int) -> tuple[DataFrame, str, str]:
    """rows with the range of their order, the name of that column, and a name for what is passed on; no other column has these."""
    taken = {c.lower() for c in rows.columns}
    cell, carried = "range", "carried"
    while cell in taken:
        cell += "_"
    while carried in taken:
        carried += "_"
    place = F.col(order).cast("double")
    cuts = sorted(set(rows.select(place.alias("o")).approxQuantile("o", [i / ranges for i in range(1, ranges)], 0.1 / ranges)))
    at = F.size(F.filter(F.array(*(F.lit(c) for c in cuts)), lambda c: c < place)) if cuts else F.lit(0)
    return rows.withColumn(cell, F.when(F.col(order).isNull(), 0).otherwise(at)), cell, carried


def beside_previous(rows: DataFrame, by: str, order: str, value: str, name: str = "previous", ranges: int = RANGES) -> DataFrame:
    """rows with one more column: value of the row before in the order, within each series of by; null for a first row.

    The order is a number. It is cut into ranges by its approximate quantiles, and each (series, range) is put in
    order alone. What the last row of a range holds is added to the next range of the series as a row of its own, which
    goes before all others there and is left out afterwards. So a row is shuffled once, and besides the cuts only a value for each
    series and range is passed on. More ranges suit larger tables.

    As with lag, null keys are one series, null orders come first, and a null value is the previous one of the row after it. Rows of
    equal order, repeated ones too, go by value. An empty table gives no rows; all other columns are kept.
    """
    rows, cell, carried = _ranged(rows, order, ranges)
    last = rows.groupBy(by, cell).agg(F.max(F.struct(F.col(order).alias("o"), F.col(value).alias("v"))).alias("last"))
    passed = last.select(by, F.lead(cell).over(W.partitionBy(by).orderBy(cell)).alias(cell), F.col("last.o").alias(order), F.col("last.v").alias(value), F.lit(True).alias(carried)).where(F.col(cell).isNotNull())
    every = rows.withColumn(carried, F.lit(False)).unionByName(passed, allowMissingColumns=True)
    before = F.lag(value).over(W.partitionBy(by, cell).orderBy(F.desc(carried), order, value))
    return every.withColumn(name, before).where(~F.col(carried)).drop(cell, carried)


def over_last(rows: DataFrame, by: str, order: str, values: list[str], reach: int, made: Callable[[WindowSpec], dict[str, Column]], ranges: int = RANGES) -> DataFrame:
    """rows with the columns that made gives over a window of their series, which may look at values of at most reach rows before.

    As in beside_previous, but the last reach rows of a range go to the next reach ranges of the series that hold any row: a range
    has one row or more, so what a row looks back on is always there. Besides the rows, reach x reach rows of by, order and values
    are passed on for each series and range. Rows of equal order go by values. Nulls and empty tables are as there.
    """
    rows, cell, carried = _ranged(rows, order, ranges)
    rank, following = f"rank_of_{cell}", f"after_{cell}"
    down = W.partitionBy(by, cell).orderBy(*(F.desc(x) for x in (order, *values)))
    last = rows.select(by, cell, order, *values, F.row_number().over(down).alias(rank)).where(F.col(rank) <= reach)
    held = rows.groupBy(by, cell).agg(F.count("*").alias(rank))
    ahead = W.partitionBy(by).orderBy(cell).rowsBetween(1, reach)
    next_ranges = held.select(F.col(by).alias("of_series"), F.col(cell).alias("of_range"), F.collect_list(cell).over(ahead).alias(following)).withColumn(following, F.explode(following))
    met = last.join(next_ranges, F.col(by).eqNullSafe(F.col("of_series")) & (F.col(cell) == F.col("of_range")))
    passed = met.select(by, F.col(following).alias(cell), order, *values, F.lit(True).alias(carried))
    every = rows.withColumn(carried, F.lit(False)).unionByName(passed, allowMissingColumns=True)
    w = W.partitionBy(by, cell).orderBy(F.desc(carried), order, *values)
    return every.select("*", *(x.alias(name) for name, x in made(w).items())).where(~F.col(carried)).drop(cell, carried)


def beside_first(rows: DataFrame, by: str, order: str, value: str, name: str = "first") -> DataFrame:
    """rows with one more column: the value of their series' first row, nulls of the order left out.

    The first rows are found by partial aggregation and joined; their number is that of the series, so
    Spark broadcasts them if they are small, and else splits hot series. Null keys are one series.
    """
    first = rows.where(F.col(order).isNotNull()).groupBy(F.col(by).alias("of_series")).agg(F.min(F.struct(F.col(order).alias("o"), F.col(value).alias("v")))["v"].alias(name))
    return rows.join(first, F.col(by).eqNullSafe(F.col("of_series")), "left").drop("of_series")
