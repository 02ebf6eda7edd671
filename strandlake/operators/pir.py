"""Private retrieval: shares of a query over servers, answers, buckets and votes, as grouped sums."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FIELD = 2**32 - 5


def share_mask(server: int, idx: Column, wanted: Column, servers: int) -> Column:
    """The bit of a server's mask for a row: random for all servers but the last, whose bit makes all masks add up to the wanted row alone."""
    bit = lambda s: (F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(str(s)), idx.cast("string")).cast("binary")), 1, 1), 16, 10).cast("int") % 2)
    if server < servers - 1:
        return bit(server)
    others = sum((bit(s) for s in range(servers - 1)), F.lit(0))
    return (others + (idx == wanted).cast("int")) % 2


def retrieved(rows: DataFrame, wanted: int, servers: int = 3) -> DataFrame:
    """(payload) of the wanted idx of rows (idx, payload long): the XOR of what each server gives for its mask. One pass gives all answers."""
    answers = [F.coalesce(F.bit_xor(F.when(share_mask(s, F.col("idx"), F.lit(wanted), servers) == 1, F.col("payload"))), F.lit(0).cast("long")).alias(f"a{s}") for s in range(servers)]
    found = rows.agg(*answers)
    payload = F.col("a0")
    for s in range(1, servers):
        payload = payload.bitwiseXOR(F.col(f"a{s}"))
    return found.select(payload.alias("payload"))


def field_shares(rows: DataFrame, seed: int = 3) -> DataFrame:
    """rows (idx, payload) as two additive shares mod FIELD."""
    first = F.pmod(F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("idx").cast("string")).cast("binary")), 1, 8), 16, 10).cast("long"), F.lit(FIELD))
    return rows.select("idx", first.alias("a"), F.pmod(F.col("payload") - first, F.lit(FIELD)).alias("b"))


def majority(answers: DataFrame, key: str, value: str) -> DataFrame:
    """(key, value, votes): what most say; of equally many the smallest."""
    counts = answers.groupBy(key, value).agg(F.count("*").alias("votes"))
    best = counts.groupBy(key).agg(F.min(F.struct((-F.col("votes")).alias("less"), F.col(value).alias("value"))).alias("x"))
    return best.select(key, F.col("x.value").alias(value), (-F.col("x.less")).alias("votes"))


def bucket_of(key: Column, buckets: int, choice: int = 0) -> Column:
    """A key's bucket by the MD5 of a choice and the key."""
    return F.pmod(F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(str(choice)), key.cast("string")).cast("binary")), 1, 8), 16, 10).cast("long"), F.lit(buckets))


def repeats_needed(epsilon: Column, delta: Column) -> tuple[Column, Column]:
    """(dimension, repeats) for an error of epsilon with a chance of delta."""
    dimension = F.least(F.lit(200_000), F.ceil(2 * F.ln(4 / delta) / F.pow(epsilon * F.sqrt(F.lit(2.0)), 2)))
    return dimension, F.ceil(F.ln(4 / delta) / (2 * epsilon * epsilon))
