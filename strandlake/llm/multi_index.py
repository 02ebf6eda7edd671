"""Approximate nearest neighbours with an inverted multi-index.

Vectors are cut into two halves, each quantised by its own k-means codebook, so an entry stands in the
cell of two centroids. A query ranks the centroids of each half and visits pairs by summed distance
with a heap, until the cells it has met hold enough different vectors. Nearness is the inner product,
so a half's distance is its negated inner product with the centroid. Entries of visited cells are
reranked exactly, in double precision, in blocks of bounded size: a cell that holds very many rows
becomes several blocks, and so do the queries that visit it.
"""

from __future__ import annotations

import heapq
import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .frames import kept

#: Vectors that the codebooks are fitted on at most, and rows in a block of entries or of queries.
FIT, BLOCK = 20_000, 4096


def kmeans(x: np.ndarray, k: int, rounds: int = 15) -> np.ndarray:
    """k centroids of x by Lloyd's rounds from rows spread over x; empty ones keep their place."""
    centers = x[np.linspace(0, len(x) - 1, k).astype(int)].copy()
    for _ in range(rounds):
        at = np.argmin((centers**2).sum(1) - 2 * x @ centers.T, axis=1)
        counts = np.bincount(at, minlength=k)
        for d in range(x.shape[1]):
            sums = np.bincount(at, weights=x[:, d], minlength=k)
            centers[counts > 0, d] = sums[counts > 0] / counts[counts > 0]
    return centers


def visited(query: np.ndarray, books: tuple[np.ndarray, np.ndarray], sizes: np.ndarray, enough: float) -> list[int]:
    """Cells by summed distance of their centroid pairs, until their sizes add up to enough."""
    half = books[0].shape[1]
    near = [-(book @ part) for book, part in zip(books, (query[:half], query[half:]), strict=True)]
    order = [np.argsort(x, kind="stable") for x in near]
    k = len(order[1])
    heap, seen, held, out = [(near[0][order[0][0]] + near[1][order[1][0]], 0, 0)], {(0, 0)}, 0, []
    while heap and held < enough:
        _, i, j = heapq.heappop(heap)
        cell = int(order[0][i]) * k + int(order[1][j])
        if sizes[cell]:
            out.append(cell)
            held += sizes[cell]
        for a, b in ((i + 1, j), (i, j + 1)):
            if a < len(order[0]) and b < k and (a, b) not in seen:
                seen.add((a, b))
                heapq.heappush(heap, (near[0][order[0][a]] + near[1][order[1][b]], a, b))
    return out


def usable(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(id, v) of vectors that have an id and only finite components, one of them not zero."""
    v = F.col("v")
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(math.inf)))
    return vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("v")).where(F.col("id").isNotNull() & v.isNotNull() & finite & F.exists(v, lambda x: x != 0))


def nearest(vectors: DataFrame, queries_every: int = 20, k: int = 20, id_col: str = "vec_id", vector_col: str = "embedding", centroids: int = 16, visit: float = 0.7) -> DataFrame:
    """(query_id, rank, id, score): the k entries of largest inner product that the index finds for each query.

    Queries are the rows whose id is divisible by queries_every, candidates all rows but those of the query's
    own id; ties go to the smaller id. Vectors that are null, zero or have a null or non-finite component take
    no part, nor rows with a null id; vectors of another length than most take no part either. Rows that repeat an id are
    entries each, and other columns aren't read, whatever their names; an empty table gives no rows. visit is the
    share of all different vectors in the cells that a query visits at least: 1 makes the search exact.
    """
    spark = vectors.sparkSession
    result = f"query_id long, rank int, {id_col} long, score double"
    rows = usable(vectors, id_col, vector_col)
    sizes = rows.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), F.desc("n")).limit(1).collect()
    if not sizes:
        return spark.createDataFrame([], result)
    width = sizes[0]["n"]
    rows = rows.where(F.size("v") == width)

    # codebooks, from FIT rows by a hash of the vector; equal vectors count once
    keyed = rows.select("v", F.xxhash64("v").alias("h")).dropDuplicates(["h"])
    sample = np.array([x["v"] for x in keyed.orderBy("h").limit(FIT).collect()], float)
    half = width // 2 or width
    n = max(1, min(centroids, int(math.sqrt(len(sample) / 8))))
    books = (kmeans(sample[:, :half], n), kmeans(sample[:, half:], n if width > half else 1))
    second, cells = len(books[1]), len(books[0]) * len(books[1])

    @F.pandas_udf(T.IntegerType())
    def cell_of(v: pd.Series) -> pd.Series:
        x = np.stack(v.to_numpy()).astype(float) if len(v) else np.zeros((0, width))
        a, b = (np.argmin((c**2).sum(1) - 2 * part @ c.T, axis=1) if part.shape[1] else np.zeros(len(x), int) for c, part in zip(books, (x[:, :half], x[:, half:]), strict=True))
        return pd.Series((a * second + b).astype(np.int32))

    index = kept(rows.withColumn("cell", cell_of("v")))
    held = index.groupBy("cell").agg(F.count("*").alias("n"), F.approx_count_distinct(F.xxhash64("v"), 0.02).alias("different")).collect()
    different, counts = np.zeros(cells), np.zeros(cells, np.int64)
    for x in held:
        different[x["cell"]], counts[x["cell"]] = x["different"], x["n"]
    enough = visit * different.sum()

    # cells of nearby size sums make groups of about BLOCK rows; a larger cell is a group of several blocks
    group_of, blocks, at, load = np.zeros(cells, np.int32), [1], 0, 0
    for c in np.argsort(counts, kind="stable"):
        if load and load + counts[c] > BLOCK:
            at, load = at + 1, 0
            blocks.append(1)
        group_of[c] = at
        load += counts[c]
        blocks[at] = -(-load // BLOCK) or 1
    asked = index.where(F.col("id") % queries_every == 0)
    parts = max(1, -(-asked.count() // BLOCK))

    def visits(batches):
        for pdf in batches:
            out = []
            for id_, v in zip(pdf["id"], pdf["v"], strict=True):
                by_group: dict[int, list[int]] = {}
                for c in visited(np.asarray(v, float), books, different, enough):
                    by_group.setdefault(int(group_of[c]), []).append(c)
                out += [(id_, v, g, b, cs) for g, cs in by_group.items() for b in range(blocks[g])]
            yield pd.DataFrame(out, columns=["id", "v", "g", "b", "cells"])

    kind = vectors.schema[vector_col].dataType.simpleString()
    questions = asked.select("id", "v").repartition("id").mapInPandas(visits, f"id long, v {kind}, g int, b int, cells array<int>")
    questions = questions.withColumn("p", F.pmod(F.xxhash64(F.lit(3), "id"), F.lit(parts)).cast("int"))
    groups = F.array(*(F.lit(int(x)) for x in group_of))
    pieces = F.array(*(F.lit(int(x)) for x in blocks))
    entries = index.withColumn("g", F.element_at(groups, F.col("cell") + 1))
    entries = entries.withColumn("b", F.pmod(F.xxhash64(F.lit(5), "id"), F.element_at(pieces, F.col("g") + 1).cast("long")).cast("int"))
    entries = entries.withColumn("p", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))

    def rank(_, entry: pd.DataFrame, question: pd.DataFrame) -> pd.DataFrame:
        none = pd.DataFrame({"query_id": pd.Series(dtype="int64"), "vec": pd.Series(dtype="int64"), "score": pd.Series(dtype=float)})
        if not len(entry) or not len(question):
            return none
        x = np.stack(entry["v"].to_numpy()).astype(float)
        ids = entry["id"].to_numpy()
        here, cell = np.unique(entry["cell"].to_numpy(), return_inverse=True)
        out = []
        for start in range(0, len(question), 256):
            part = question.iloc[start : start + 256]
            asked, v = part["id"].to_numpy(), np.stack(part["v"].to_numpy()).astype(float)
            met = np.zeros((len(part), len(here)), bool)
            cells_of = np.concatenate(part["cells"].to_numpy())
            rows = np.repeat(np.arange(len(part)), part["cells"].map(len).to_numpy())
            place = np.minimum(np.searchsorted(here, cells_of), len(here) - 1)
            ok = here[place] == cells_of
            met[rows[ok], place[ok]] = True
            rough = np.where(met[:, cell] & (ids != asked[:, None]), v @ x.T, -np.inf)
            # those that may be among the k best, whatever the last digits; their exact scores decide
            least = np.partition(rough, -k, axis=1)[:, -k] if len(ids) > k else np.full(len(part), -np.inf)
            least = np.where(np.isfinite(least), least - 1e-9 * np.maximum(1.0, np.abs(least)), -np.finfo(float).max)
            q, e = np.nonzero(rough >= least[:, None])
            true = np.zeros(len(q))
            for d in range(width):  # from the first component to the last, so that equal rows score equally
                true += x[e, d] * v[q, d]
            order = np.lexsort((ids[e], -true, q))
            q, e, true = q[order], e[order], true[order]
            top = np.arange(len(q)) - np.searchsorted(q, q) < k
            out.append(pd.DataFrame({"query_id": asked[q[top]], "vec": ids[e[top]], "score": true[top]}))
        return pd.concat(out) if out else none

    found = entries.groupBy("g", "b", "p").cogroup(questions.groupBy("g", "b", "p")).applyInPandas(rank, "query_id long, vec long, score double")
    best = found.selectExpr("*", "cast(row_number() over (partition by query_id order by score desc, vec) as int) as rank").where(F.col("rank") <= k)
    return best.select("query_id", "rank", F.col("vec").alias(id_col), "score")
