"""Hash chains and hash trees."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .steps import Steps


def _folded(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    ledger, last = None, ""
    for batch in batches:
        hashes = []
        for of, payload in zip(batch["ledger"], batch["payload"], strict=True):
            if of != ledger:
                ledger, last = of, "GENESIS"
            last = hashlib.sha256(f"{last}|{payload}".encode()).hexdigest()
            hashes.append(last)
        yield batch[["ledger", "idx"]].assign(hash=hashes)


def chained(entries: DataFrame) -> DataFrame:
    """Entries (ledger, idx, payload) with hash: each over the hash before it, GENESIS first.

    A chain is sequential by nature: a ledger is folded by one task, batch after batch in its order, and only the last
    hash is held. A null ledger is a ledger; a null payload counts as None.
    """
    kinds = {x.name: x.dataType.simpleString() for x in entries.schema}
    ordered = entries.select("ledger", "idx", "payload").repartition("ledger").sortWithinPartitions("ledger", "idx")
    return ordered.mapInPandas(_folded, f"ledger {kinds['ledger']}, idx {kinds['idx']}, hash string")


def verified(chain: DataFrame) -> DataFrame:
    """(ledger, entries, broken): of chains (ledger, idx, payload, hash), entries that don't follow from the one before."""
    w = W.partitionBy("ledger").orderBy("idx")
    before = F.coalesce(F.lag("hash").over(w), F.lit("GENESIS"))
    ok = (F.sha2(F.concat_ws("|", before, F.col("payload")), 256) == F.col("hash")) & (F.row_number().over(w) - 1 == F.col("idx"))
    return chain.select("ledger", ok.alias("ok")).groupBy("ledger").agg(F.count("*").alias("entries"), F.count_if(~F.col("ok")).alias("broken"))


def _framed(*parts) -> F.Column:
    """SHA-256 of parts, each after its length in four bytes, big end first."""
    return F.sha2(F.concat(*(F.concat(F.unhex(F.lpad(F.hex(F.octet_length(x).cast("long")), 8, "0")), x) for x in parts)), 256)


def merkle_levels(leaves: DataFrame, tag: str = "NODE") -> list[DataFrame]:
    """The levels (idx, hash) of a hash tree over leaves (idx from 0, hash as hex), leaves first; an odd last node is hashed with itself."""
    level, n, out = leaves.select("idx", "hash"), leaves.count(), []
    out.append(level)
    while n > 1:
        pairs = level.groupBy(F.expr("idx div 2").alias("p")).agg(F.min_by("hash", "idx").alias("a"), F.max_by("hash", "idx").alias("b"))
        level = pairs.select(F.col("p").alias("idx"), _framed(F.lit(tag).cast("binary"), F.unhex("a"), F.unhex("b")).alias("hash"))
        out.append(level)
        n = -(-n // 2)
    return out


def merkle_path(leaves: DataFrame, idx: int) -> DataFrame:
    """(level, idx, hash): the sibling on each level of the path from a leaf to the root; an odd last node is its own."""
    levels, found = merkle_levels(leaves)[:-1], None
    for k, level in enumerate(levels):
        at = idx >> k
        own = level.where(F.col("idx").isin(at, at ^ 1)).agg(F.max_by("hash", F.col("idx") == (at ^ 1)).alias("hash"))
        one = own.select(F.lit(k).alias("level"), F.lit(at ^ 1).cast("long").alias("idx"), "hash")
        found = one if found is None else found.unionByName(one)
    return found


def merkle_root(leaves: DataFrame) -> DataFrame:
    """(root, levels) over leaves (idx from 0, hash): pairs are hashed together, an odd last one with itself, level by level."""
    level, n, levels = leaves.select("idx", "hash"), leaves.count(), 0
    while n > 1:
        pairs = level.groupBy(F.expr("idx div 2").alias("p")).agg(F.min_by("hash", "idx").alias("a"), F.max_by("hash", "idx").alias("b"))
        level = pairs.select(F.col("p").alias("idx"), F.sha2(F.concat("a", "b"), 256).alias("hash"))
        n, levels = -(-n // 2), levels + 1
    return level.select(F.col("hash").alias("root"), F.lit(levels).alias("levels"))


def merkle_verified(leaves: DataFrame, claims: DataFrame, tag: str = "NODE") -> DataFrame:
    """claims (idx, hash) to (idx, valid): whether each hash, hashed up the tree with the siblings that the tree of leaves (idx from 0, hash) has, gives its root.

    All claims go up together, a join a level with that level's siblings, and each level of the tree is written once. A claim beyond the leaves, or a
    null one, isn't valid; claims may repeat. Without leaves no claim is.
    """
    steps, n = Steps(leaves.sparkSession), leaves.count()
    level = steps.written(leaves.select("idx", "hash"), "level")
    up = claims.select("idx", "hash", F.col("idx").alias("at"))
    while n > 1:
        # the pair of each node: itself and its sibling, or itself twice where an odd last one has none
        pairs = steps.written(level.groupBy(F.expr("idx div 2").alias("p")).agg(F.min_by("hash", "idx").alias("a"), F.max_by("hash", "idx").alias("b")), "pairs")
        even = F.col("at") % 2 == 0
        met = up.join(pairs, F.expr("at div 2") == F.col("p"), "left")
        alone = F.col("at") == n - 1
        left, right = F.when(even, F.col("hash")).otherwise(F.col("a")), F.when(even, F.when(alone, F.col("hash")).otherwise(F.col("b"))).otherwise(F.col("hash"))
        hashed = _framed(F.lit(tag).cast("binary"), F.unhex(left), F.unhex(right))
        up = met.select("idx", F.when(F.col("p").isNotNull(), hashed).alias("hash"), F.expr("at div 2").alias("at"))
        level = pairs.select(F.col("p").alias("idx"), _framed(F.lit(tag).cast("binary"), F.unhex("a"), F.unhex("b")).alias("hash"))
        n = -(-n // 2)
    root = level.agg(F.max("hash").alias("root"))  # one row
    inside = F.col("idx").between(0, leaves.count() - 1)
    return up.join(F.broadcast(root)).select("idx", F.coalesce(inside & (F.col("hash") == F.col("root")), F.lit(False)).alias("valid"))
