"""Vector algebra on array columns, as expressions that stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def total(v: Column) -> Column:
    return F.aggregate(v, F.lit(0.0), lambda a, x: a + x.cast("double"))


def dot(a: Column, b: Column) -> Column:
    return total(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")))


def norm(v: Column) -> Column:
    return F.sqrt(dot(v, v))


def cosine(a: Column, b: Column) -> Column:
    """0 if either vector has no length."""
    lengths = norm(a) * norm(b)
    return F.when(lengths == 0, F.lit(0.0)).otherwise(dot(a, b) / lengths)


def euclidean(a: Column, b: Column) -> Column:
    return F.sqrt(total(F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double")))))


def hamming(a: Column, b: Column) -> Column:
    """How many components differ in being positive."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: ((x > 0) != (y > 0)).cast("int")), F.lit(0), lambda s, x: s + x)


def rolled(v: Column, k: int) -> Column:
    """v, with its last k components moved to the front."""
    return F.concat(F.slice(v, F.size(v) - k + 1, F.lit(k)), F.slice(v, F.lit(1), F.size(v) - k)) if k else v


def bound(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))


def circular(a: Column, b: Column) -> Column:
    """Circular convolution: c[i] = sum of a[j] * b[i - j]."""
    n = F.size(a)
    at = lambda i: F.aggregate(F.sequence(F.lit(0), n - 1), F.lit(0.0), lambda s, j: s + F.get(a, j).cast("double") * F.get(b, F.pmod(i - j, n)).cast("double"))
    return F.transform(F.sequence(F.lit(0), n - 1), at)
