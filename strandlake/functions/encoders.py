"""Encoders of vectors: binding by roles and positions, random projections, quantising, similarity of pairs.

Random parts come from MD5 of a seed and a place, so every engine and every run has the same ones.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def unbound(a: Column, b: Column) -> Column:
    """a / (b + 1e-8), which undoes binding by multiplication."""
    return F.zip_with(a, b, lambda x, y: x.cast("double") / (y.cast("double") + 1e-8))


def bound_xor(a: Column, b: Column) -> Column:
    """1 where just one of both is positive, else -1."""
    return F.zip_with(a, b, lambda x, y: F.when((x > 0) != (y > 0), 1).otherwise(-1))


def weighted(v: Column, weight: Column) -> Column:
    return F.transform(v, lambda x: x.cast("double") * weight)


def position_vector(place: Column, size: int) -> Column:
    """sin and cos in turn, of the place over 10000 ** (i / size)."""
    angle = lambda i: place / F.pow(F.lit(10000.0), (i - i % 2) / F.lit(float(size)))
    return F.transform(F.sequence(F.lit(0), F.lit(size - 1)), lambda i: F.when(i % 2 == 0, F.sin(angle(i))).otherwise(F.cos(angle(i))))


@F.pandas_udf(T.ArrayType(T.DoubleType()))
def circular_fft(a: pd.Series, b: pd.Series) -> pd.Series:
    """Circular convolution of pairs of vectors, by FFT; null where either is null or their sizes differ."""
    return pd.Series([None if x is None or y is None or len(x) != len(y) else np.fft.irfft(np.fft.rfft(np.asarray(x, float)) * np.fft.rfft(np.asarray(y, float)), len(x)) for x, y in zip(a, b, strict=True)])


def sign_of(seed: int, row: Column, column: Column) -> Column:
    """1 or -1, by the first hex digit of an MD5."""
    digit = F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), row.cast("string"), column.cast("string")).cast("binary")), 1, 1), 16, 10).cast("int")
    return F.when(digit < 8, 1).otherwise(-1)


def projected(vectors: DataFrame, key: str, vector: str, rows: int, seed: int = 7) -> DataFrame:
    """(key, row, value): vectors times a random matrix of rows x size signs, over sqrt(rows). The matrix is made in the plan; its cells are few."""
    cells = vectors.select(key, F.posexplode(vector).alias("pos", "x"))
    sizes = cells.select("pos").distinct()
    matrix = sizes.select("pos", F.explode(F.sequence(F.lit(0), F.lit(rows - 1))).alias("row"))
    matrix = matrix.select("pos", "row", sign_of(seed, F.col("row"), F.col("pos")).alias("sign"))
    by = cells.join(matrix, "pos").groupBy(key, "row").agg(F.sum(F.col("x").cast("double") * F.col("sign")).alias("s"))
    return by.select(key, "row", (F.col("s") / F.sqrt(F.lit(float(rows)))).alias("value"))


def quantized(v: Column, levels: int) -> Column:
    """Each component's level, 0 to levels - 1, between the vector's least and largest."""
    low, high = F.array_min(v).cast("double"), F.array_max(v).cast("double")
    return F.transform(v, lambda x: F.bround((x.cast("double") - low) / F.greatest(high - low, F.lit(1e-12)) * (levels - 1)).cast("int"))


def every_nth(v: Column, n: int) -> Column:
    return F.filter(v, lambda x, i: i % n == 0)


def jaccard_minmax(a: Column, b: Column) -> Column:
    """Sum of minima over sum of maxima, of absolute values; 0 for two zero vectors."""
    part = lambda f: F.aggregate(F.zip_with(a, b, lambda x, y: f(F.abs(x), F.abs(y)).cast("double")), F.lit(0.0), lambda s, x: s + x)
    return F.coalesce(part(F.least) / F.nullif(part(F.greatest), F.lit(0.0)), F.lit(0.0))


def jaccard_bool(a: Column, b: Column) -> Column:
    """Of the components that either has positive, the share that both have."""
    count = lambda f: F.size(F.filter(F.zip_with(a, b, f), lambda x: x))
    return F.coalesce(count(lambda x, y: (x > 0) & (y > 0)) / F.nullif(count(lambda x, y: (x > 0) | (y > 0)), F.lit(0)), F.lit(0.0))


def mean_absolute(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.abs(x.cast("double") - y.cast("double"))), F.lit(0.0), lambda s, x: s + x) / F.size(a)


def average_ranks(v: Column) -> Column:
    """The rank of each component from 1, equal ones at their average. Time grows with the square of the size."""
    return F.transform(v, lambda x: F.size(F.filter(v, lambda y: y < x)) + (F.size(F.filter(v, lambda y: y == x)) + 1) / F.lit(2.0))


def pearson(a: Column, b: Column) -> Column:
    """The correlation of two arrays of one size; 0 where either doesn't vary."""
    total = lambda v: F.aggregate(v, F.lit(0.0), lambda s, x: s + x)
    middle = lambda v: F.transform(v, lambda x: x.cast("double") - F.aggregate(v, F.lit(0.0), lambda s, y: s + y.cast("double")) / F.size(v))
    both = F.transform(F.array(F.struct(middle(a).alias("a"), middle(b).alias("b"))), lambda c: total(F.zip_with(c["a"], c["b"], lambda x, y: x * y)) / F.nullif(F.sqrt(total(F.transform(c["a"], lambda x: x * x)) * total(F.transform(c["b"], lambda x: x * x))), F.lit(0.0)))
    return F.coalesce(F.get(both, F.lit(0)), F.lit(0.0))


def spearman(a: Column, b: Column) -> Column:
    """The correlation of ranks."""
    ranks = F.transform(F.array(F.struct(average_ranks(a).alias("a"), average_ranks(b).alias("b"))), lambda c: pearson(c["a"], c["b"]))
    return F.get(ranks, F.lit(0))


def haplotype(a: Column, b: Column) -> Column:
    """The share of places where both have the same value; null for empty arrays."""
    return F.size(F.filter(F.zip_with(a, b, lambda x, y: x == y), lambda x: x)) / F.nullif(F.size(a), F.lit(0))


def structural(a: Column, b: Column) -> Column:
    """The overlap of absolute values, over the smaller sum; 0 if that is 0."""
    total = lambda v: F.aggregate(v, F.lit(0.0), lambda s, x: s + F.abs(x.cast("double")))
    shared = F.aggregate(F.zip_with(a, b, lambda x, y: F.least(F.abs(x.cast("double")), F.abs(y.cast("double")))), F.lit(0.0), lambda s, x: s + x)
    return F.coalesce(shared / F.nullif(F.least(total(a), total(b)), F.lit(0.0)), F.lit(0.0))
