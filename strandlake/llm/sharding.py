"""Shards balanced in bytes, tokens and rows at once, by vector bin packing.

Equal texts form a group with a vector (bytes, tokens, rows). Largest groups come first, and each
goes to the shard where the dot product of its vector with the shard's residual capacity is highest.
Each group is placed by itself. Up to MOST_GROUPS groups the driver places them all; of more, those above a fine share of any total,
at most 3 / share of them. What these leave of each shard is dealt to cells of the other groups, by what a cell weighs, and a task
places a cell's groups by the same rule into its part, so neither the driver nor a task sees all groups of a large input.

A group of more than a fair shard is split over several shards row by row; what these rows really
weigh is measured before the rest is placed.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .frames import kept

#: Groups that the driver places all; of more, the share of a total from which on it places one, and how many of the others are in a cell, about.
MOST_GROUPS, SHARE, CELL_GROUPS = 65_536, 1 / 16384, 16_384
#: What a group weighs.
KINDS = ["bytes", "tokens", "rows"]
#: What bytes, tokens and rows count for in the dot product; the law that holds is that of bytes.
WEIGHTS = np.array([6.0, 1.0, 1.0])
#: Cells of a shard in which rows get their slots, each numbered alone.
CELLS = 512


def place(vectors: np.ndarray, residual: np.ndarray) -> np.ndarray:
    """The shard of each vector, heaviest first. residual (shards x dimensions, in shares of a fair shard) is used up."""
    out = np.zeros(len(vectors), np.int32)
    for i in np.argsort(-vectors.max(axis=1, initial=0), kind="stable"):
        fit = residual @ (vectors[i] * WEIGHTS)
        out[i] = best = int(np.argmax(fit))
        residual[best] -= vectors[i]
    return out


def pack_shards(docs: DataFrame, shards: int = 24, id_col: str = "doc_id", text_col: str = "text", overhead: int = 8) -> DataFrame:
    """One row per row of docs: id, size (UTF-8 bytes and overhead), text_crc32, n_tokens (words), shard, slot.

    Equal texts share a shard unless together they outweigh a fair shard in any dimension. Null texts are
    one group of size overhead with a null text_crc32; a null id is a value like others. Slots number a
    shard's rows from 0 without a gap. An empty table gives no rows.
    """
    text = F.col(text_col).cast("string")
    rows = docs.select(
        F.col(id_col).alias("id"),
        (F.coalesce(F.octet_length(text), F.lit(0)) + overhead).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("crc"),
        F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long").alias("tokens"),
        F.coalesce(F.unhex(F.md5(text.cast("binary"))), F.lit(b"")).alias("key"),
    )
    rows = kept(rows)
    groups = kept(rows.groupBy("key").agg(F.sum("size").alias("bytes"), F.sum("tokens").alias("tokens"), F.count("*").alias("rows")))
    totals = groups.agg(*(F.sum(k).alias(k) for k in KINDS), F.count("*").alias("groups")).first()
    fair = np.array([max(1, totals[k] or 0) / shards for k in KINDS])
    all_here = totals["groups"] <= MOST_GROUPS
    large = F.greatest(*(F.col(k) / F.lit(float(max(1, totals[k] or 0))) for k in KINDS)) > (-1 if all_here else SHARE)
    alone = groups.where(large).orderBy("key").toPandas()

    residual = np.ones((shards, 3))
    spark = docs.sparkSession
    vectors = alone[KINDS].to_numpy(float) / fair
    pieces = [min(shards, 2 * int(np.ceil(v))) if v > 1 else 1 for v in vectors.max(axis=1, initial=0)]
    split = []  # (key, pieces, shards)
    for key, n, vector in sorted(zip(alone["key"], pieces, vectors, strict=True), key=lambda x: -x[1]):
        if n > 1:
            at = place(np.tile(vector / n, (n, 1)), residual)
            split.append((bytes(key), n, [int(x) for x in at]))
    whole = [i for i, n in enumerate(pieces) if n == 1]
    splits = spark.createDataFrame(split, "key binary, pieces int, at array<int>")
    piece = F.pmod(F.xxhash64(F.lit(7), "id"), F.col("pieces").cast("long")).cast("int")
    parts = rows.join(F.broadcast(splits), "key").select("id", "size", "crc", "tokens", F.element_at("at", piece + 1).alias("shard"))
    if split:
        residual = np.ones((shards, 3))
        for x in parts.groupBy("shard").agg(F.sum("size").alias("bytes"), F.sum("tokens").alias("tokens"), F.count("*").alias("rows")).collect():
            residual[x["shard"]] -= np.array([x[k] for k in KINDS]) / fair
    at = place(vectors[whole], residual)
    own = spark.createDataFrame([(bytes(alone["key"][i]), int(s)) for i, s in zip(whole, at, strict=True)], "key binary, own int")
    # both maps here have at most MOST_GROUPS or 3 / SHARE rows
    rest = rows.join(F.broadcast(splits), "key", "left_anti").join(F.broadcast(own), "key", "left")
    placed = parts.unionByName(rest.where("own is not null").select("id", "size", "crc", "tokens", F.col("own").alias("shard")))
    if not all_here:
        # the others' map grows with the texts; a key of very many rows isn't in it
        others = placed_in_cells(groups.where(~large), totals["groups"], residual, fair)
        placed = placed.unionByName(rest.where("own is null").join(others.hint("merge"), "key").select("id", "size", "crc", "tokens", "shard"))
    return numbered(placed, shards).select(F.col("id").alias(id_col), "size", F.col("crc").alias("text_crc32"), F.col("tokens").alias("n_tokens"), "shard", "slot")


def placed_in_cells(groups: DataFrame, n: int, residual: np.ndarray, fair: np.ndarray) -> DataFrame:
    """(key, shard) of groups (key, bytes, tokens, rows), at most n: each cell of them fills its part of residual, which is its part of their weight."""
    cells = -(-n // CELL_GROUPS)
    left = np.maximum(residual.sum(axis=0), 1e-12)

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell = pa.Table.from_batches(list(batches)).sort_by("key")
        vectors = np.stack([cell.column(k).to_numpy() for k in KINDS], axis=1) / fair
        shard = place(vectors, residual * (vectors.sum(axis=0) / left))
        yield pa.RecordBatch.from_arrays([cell.column("key").combine_chunks(), pa.array(shard)], ["key", "shard"])

    celled = groups.select("key", *KINDS, F.pmod(F.xxhash64(F.lit(13), "key"), F.lit(cells)).cast("int").alias("cell"))
    return celled.repartition(cells, "cell").groupBy("cell").applyInArrow(fill, "key binary, shard int")


def numbered(placed: DataFrame, shards: int) -> DataFrame:
    """placed with slot: in each shard from 0, by cells of the id's hash, so no task numbers a whole shard."""
    placed = kept(placed.withColumn("cell", F.pmod(F.xxhash64(F.lit(11), "id", "crc"), F.lit(CELLS)).cast("int")))
    counts = placed.groupBy("shard", "cell").count()
    before = counts.selectExpr("shard", "cell", "sum(count) over (partition by shard order by cell rows between unbounded preceding and current row) - count as base")
    own = placed.selectExpr("*", "row_number() over (partition by shard, cell order by id, crc, size) - 1 as place")
    return own.join(F.broadcast(before), ["shard", "cell"]).withColumn("slot", (F.col("base") + F.col("place")).cast("long"))  # shards * CELLS rows
