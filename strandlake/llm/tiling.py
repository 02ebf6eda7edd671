"""Benchmark decontamination by greedy string tiling.

Words are runs of letters, digits and bytes above 0x7F, lower-cased in A-Z; other ASCII characters only
separate them. A document and an item that share a seed of seed words are tiled: the longest matches
that don't overlap any marked word are marked first, found by running Karp-Rabin hashes of ever shorter
windows, down to seed words. What counts is the share of the item's words that end up marked, in
whatever order its parts stand in the document.

Items are joined to documents in blocks: a block's seeds are broadcast, and a block holds at most
about BLOCK_WORDS words however large the benchmark is. Documents aren't shuffled.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .frames import kept
from .words import _BASE, _BYTE_LOWER, _power, byte_chunks, chained, mix

#: Words of a block of items, all of it known to the tasks at once.
BLOCK_WORDS = 1_000_000
_KEEPS = np.zeros(256, bool)
_KEEPS[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True


def bare_words(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The hash of each word, without punctuation, and the first word of each text (one more at the end)."""
    n = len(texts)
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + n + 1]
    data = texts.buffers()[2]
    raw = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None else np.zeros(0, np.uint8)
    offsets = offsets - offsets[0]
    inside = np.zeros(len(raw) + 2, bool)
    inside[1:-1] = _KEEPS[raw]
    edge = np.zeros(len(raw) + 1, bool)
    edge[offsets] = True
    starts = np.flatnonzero(inside[1:-1] & (~inside[:-2] | edge[:-1]))
    ends = np.flatnonzero(inside[1:-1] & (~inside[2:] | edge[1:])) + 1
    up, down = _power(len(raw))
    sums = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum(_BYTE_LOWER[raw] * up[: len(raw)], out=sums[1:])
    return mix((sums[ends] - sums[starts]) * down[starts]), np.searchsorted(starts, offsets)


def windows(words: np.ndarray, size: int) -> np.ndarray:
    """Running Karp-Rabin hashes of all windows of size words."""
    up, down = _power(len(words))
    sums = np.zeros(len(words) + 1, np.uint64)
    np.cumsum(words * up[: len(words)], out=sums[1:])
    n = len(words) - size + 1
    return (sums[size:] - sums[:n]) * down[:n] if n > 0 else np.zeros(0, np.uint64)


def tiles(item: np.ndarray, doc: np.ndarray, least: int) -> list[tuple[int, int, int]]:
    """(place in item, place in doc, words) of greedily marked matches of at least least words, longest first.

    Only the document's words that the item has can be part of a match, so the others are left out first.
    """
    place = np.flatnonzero(np.isin(doc, item))
    doc = doc[place]
    free_item, free_doc = np.ones(len(item), bool), np.ones(len(doc), bool)
    out: list[tuple[int, int, int]] = []
    for size in range(min(len(item), len(doc)), least - 1, -1):
        a, b = windows(item, size), windows(doc, size)
        joined = place[size - 1 :] - place[: len(b)] == size - 1
        starts: dict[int, list[int]] = {}
        for j in np.flatnonzero(joined & np.isin(b, a)).tolist():
            starts.setdefault(int(b[j]), []).append(j)
        if not starts:
            continue
        for i, key in enumerate(a.tolist()):
            for j in starts.get(key, ()):
                if free_item[i : i + size].all() and free_doc[j : j + size].all() and (item[i : i + size] == doc[j : j + size]).all():
                    out.append((i, int(place[j]), size))
                    free_item[i : i + size] = free_doc[j : j + size] = False
                    break
        if not free_item.any():
            break
    return out


def decontaminate(docs: DataFrame, benchmark: DataFrame, seed: int = 5, coverage: float = 0.6, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """(id, item, coverage, marked, item_words, tiles) for each row of docs that has at least coverage of an item's words.

    tiles are structs (item_start, doc_start, words). Items of fewer words than seed match as a whole; items
    without words, null texts and null items match nothing. Repeated rows give a result each, equal items too.
    An empty benchmark gives no rows, nor does an empty table. Texts are tiled whole, however long; of matches of one
    length the first in the item, then in the document is marked.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    items = benchmark.select(F.col(item_col).alias("item"), F.col(item_text_col).cast("string").alias("text")).where("text is not null")
    kinds = [x.schema[0].dataType.simpleString() for x in (rows, items)]
    schema = f"id {kinds[0]}, item {kinds[1]}, coverage double, marked int, item_words int, tiles array<struct<item_start:int,doc_start:int,words:int>>"
    words = items.agg(F.sum(F.octet_length("text") / 2 + 1)).first()[0]  # at most
    blocks = 0 if words is None else max(1, -(-int(words) * 4 // (3 * BLOCK_WORDS)))
    sized = items.withColumn("block", F.pmod(F.xxhash64("item", "text"), F.lit(max(1, blocks))))
    out = None
    for block in range(blocks):
        part = sized.where(F.col("block") == block).select("item", "text").toArrow()
        given = spark.sparkContext.broadcast(_seeded(part, seed))
        found = rows.mapInArrow(lambda b, given=given: _tiled(b, given.value, seed, coverage, schema_names), schema)
        if blocks > 1:  # no more than one block is held at a time
            found = kept(found)
            given.destroy()
        out = found if out is None else out.unionByName(found)
    out = spark.createDataFrame([], schema) if out is None else out
    return out.withColumnsRenamed({"id": id_col, "item": item_col})


schema_names = ["id", "item", "coverage", "marked", "item_words", "tiles"]
_TILE = pa.list_(pa.struct([("item_start", pa.int32()), ("doc_start", pa.int32()), ("words", pa.int32())]))


def _seeded(part: pa.Table, seed: int):
    """Of a block of items: ids, words, and sorted (seed hash, item place). An item shorter than seed has one seed of all its words."""
    words: list[np.ndarray] = []
    for _, texts in byte_chunks(part.column("text")):
        hashes, first = bare_words(texts)
        words += [hashes[a:b] for a, b in zip(first[:-1], first[1:], strict=True)]
    sizes = sorted({min(seed, len(w)) for w in words} - {0})
    tables = []
    for size in sizes:
        held = [(np.unique(chained(w, size)), i) for i, w in enumerate(words) if min(seed, len(w)) == size]
        keys = np.concatenate([k for k, _ in held])
        place = np.concatenate([np.full(len(k), i) for k, i in held])
        order = np.argsort(keys, kind="stable")
        tables.append((size, keys[order], place[order]))
    return part.column("item").combine_chunks(), words, tables


def _tiled(batches, given, seed: int, coverage: float, names):
    items, words, tables = given
    for batch in batches:
        ids = batch.column(0)
        rows = []
        for start, texts in byte_chunks(batch.column(1)):
            hashes, first = bare_words(texts)
            pairs = []
            for size, keys, place in tables:
                grams = chained(hashes, size)
                # a seed may not run into the next text
                last = np.repeat(first[1:], np.diff(first))[: len(grams)] - size
                low = np.searchsorted(keys, grams)
                hit = np.flatnonzero((keys[np.minimum(low, len(keys) - 1)] == grams) & (np.arange(len(grams)) <= last))
                doc = np.searchsorted(first, hit, "right") - 1
                for d, at in set(zip(doc.tolist(), low[hit].tolist(), strict=True)):
                    end = int(np.searchsorted(keys, keys[at], "right"))
                    pairs += [(d, int(i)) for i in place[at:end]]
            for d, i in sorted(set(pairs)):
                item = words[i]
                found = tiles(item, hashes[first[d] : first[d + 1]], min(seed, len(item)))
                marked = sum(x[2] for x in found)
                if marked >= coverage * len(item):
                    rows.append((start + d, i, marked / len(item), marked, len(item), [{"item_start": a, "doc_start": b, "words": n} for a, b, n in found]))
        cols = list(zip(*rows, strict=True)) or [[]] * 6
        arrays = [ids.take(pa.array(cols[0], pa.int64())), items.take(pa.array(cols[1], pa.int64())), pa.array(cols[2], pa.float64()), pa.array(cols[3], pa.int32()), pa.array(cols[4], pa.int32()), pa.array(cols[5], _TILE)]
        if rows:
            yield pa.RecordBatch.from_arrays(arrays, names)
