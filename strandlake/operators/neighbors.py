"""The nearest rows of every row, exactly: blocks of rows against blocks, those pruned that can't hold any."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .steps import Steps

#: Bytes of a block's vectors: what a task holds beside one other block.
BLOCK_BYTES = 16 << 20
#: Pivots at most, by whose nearest rows are dealt into blocks; more rows make more blocks of a pivot.
MOST_PIVOTS = 4096
#: Tasks that share one block's work.
SALTS = 4
DIGITS = 9
#: Scores that are held at a time, and of how many rows of the other block.
STRIP, COLUMNS = 1 << 21, 4096


def _vectors(column: pa.Array) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Euclidean distances of all rows of a to all of b."""
    return np.sqrt(np.maximum((a * a).sum(1)[:, None] + (b * b).sum(1) - 2 * a @ b.T, 0))


def _dealer(pivots: np.ndarray):
    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                far = _distances(_vectors(batch.column(1)), pivots)
                near = far.argmin(1)
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(near.astype(np.int64)), pa.array(far[np.arange(len(near)), near])], ["id", "v", "pivot", "far"])

    return deal


def _packed(batch: pa.Table) -> pa.Table:
    """One row for a block: its pivot and number, its ids, and its vectors as bytes."""
    ids = batch.column("id").to_numpy()
    order = np.argsort(ids)
    v = np.ascontiguousarray(_vectors(batch.column("v"))[order])
    row = {"pivot": [batch.column("pivot")[0].as_py()], "part": [batch.column("part")[0].as_py()], "ids": [ids[order].tobytes()], "v": [v.tobytes()]}
    return pa.table(row, schema=pa.schema([("pivot", pa.int64()), ("part", pa.int64()), ("ids", pa.binary()), ("v", pa.binary())]))


def _searcher(dim: int, k: int, metric: str):
    """A function over rows (key, kind, ids, v), sorted by key and kind: first the block that asks, then those that it meets, one at a time."""

    def scores(q: np.ndarray, t: np.ndarray) -> np.ndarray:
        if metric == "cosine":
            return q @ t.T
        middle = q.mean(0)  # near the origin differences of squares are exact enough
        return -_distances(q - middle, t - middle)

    def found(key, ids, top, near):
        some = near >= 0
        rows = np.repeat(np.arange(len(ids)), some.sum(1))
        return pa.RecordBatch.from_arrays([pa.array(ids[rows]), pa.array(near[some]), pa.array(top[some])], ["id", "near", "score"])

    def merged(asked, ids, top, near, own, v):
        """The k best of each row among those so far and a block's, by score and then by id.

        A strip of scores is compared with each row's k-th best so far, and only what reaches it is rounded and sorted.
        """
        for a in range(0, len(own), COLUMNS):
            o = own[a : a + COLUMNS]
            s = scores(asked, v[a : a + COLUMNS])
            if near[:, -1].min(initial=0) < 0 and len(o) > k:  # the k-th best of these columns, its own id aside, bounds it as well
                least = np.maximum(top[:, -1], np.partition(s, len(o) - 1 - k, 1)[:, len(o) - 1 - k])
            else:
                least = top[:, -1]
            r, c = np.nonzero(s >= (least - 10.0**-DIGITS)[:, None])
            other = ids[r] != o[c]
            r, c = r[other], c[other]
            if not len(r):
                continue
            held, place = np.nonzero(near >= 0)
            row = np.concatenate([held, r])
            score = np.concatenate([top[held, place], np.round(s[r, c], DIGITS)])
            of = np.concatenate([near[held, place], o[c]])
            order = np.lexsort((of, -score, row))
            row, score, of = row[order], score[order], of[order]
            rank = np.arange(len(row)) - np.searchsorted(row, row)
            best = rank < k
            top, near = np.full_like(top, -np.inf), np.full_like(near, -1)
            top[row[best], rank[best]], near[row[best], rank[best]] = score[best], of[best]
        return top, near

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key = None
        for batch in batches:
            for row in range(batch.num_rows):
                here, kind = batch.column(0)[row].as_py(), batch.column(1)[row].as_py()
                own = np.frombuffer(batch.column(2)[row].as_buffer(), np.int64)
                v = np.frombuffer(batch.column(3)[row].as_buffer(), np.float64).reshape(-1, dim)
                if kind == 0:
                    if key is not None:
                        yield found(key, ids, top, near)
                    key, ids, asked = here, own, v
                    top, near = np.full((len(ids), k), -np.inf), np.full((len(ids), k), -1, np.int64)
                    continue
                step = max(1, STRIP // min(COLUMNS, max(1, len(own))))
                strips = [merged(asked[a : a + step], ids[a : a + step], top[a : a + step], near[a : a + step], own, v) for a in range(0, len(ids), step)]
                top, near = (np.concatenate(x) for x in zip(*strips, strict=True))
        if key is not None:
            yield found(key, ids, top, near)

    return search


def _pairs(pivots: np.ndarray, radii: np.ndarray, counts: np.ndarray, reach: np.ndarray | None, k: int):
    """A function from pivots to (pivot, other): without reach the nearest ones that hold k rows beside its own, else all others within its reach."""

    slack = 1e-6 * (1 + float(np.abs(pivots).max()) + float(radii.max()))

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for q in batch.column(0).to_numpy():
                far = _distances(pivots[q : q + 1], pivots)[0]
                order = np.lexsort((np.arange(len(far)), far))
                order = np.concatenate([[q], order[order != q]])  # pivots may be equal in rounding
                first = order[: 1 + int(np.searchsorted(np.cumsum(counts[order]), k, "right"))]
                if reach is not None:
                    others = np.setdiff1d(np.flatnonzero(far - radii[q] - radii <= reach[q] + slack), first)
                    first = others[counts[others] > 0]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(first), q)), pa.array(first.astype(np.int64))], ["q", "t"])

    return pairs


def knn_graph(vectors: DataFrame, k: int = 10, metric: str = "cosine", block_rows: int | None = None) -> DataFrame:
    """vectors (id long, vector) to the k nearest others of each row: id, rank (from 1), near, score.

    The score is the cosine, or with metric "euclidean" the distance less than zero; it is rounded to DIGITS places, equal ones
    go by the smaller id. Vectors that are null or hold null or non-finite components take no part, nor, for cosines, do
    those of length zero; all others must have one dimension. Fewer than k others give fewer rows. Ids are taken as distinct.

    Equal vectors are searched for once, and each is listed by its k + 1 smallest ids, which is all that anyone's nearest can
    need of it. The rest are dealt by their nearest pivot (a bounded sample of rows) into blocks of bounded size. A block first meets
    the blocks of its own pivot and of enough near ones, which bounds how far its k nearest can be; then only those whose
    pivot, less both radii, is within that bound. The bound is exact, so no pair is lost; where vectors have no structure
    nothing is pruned, and all blocks meet.
    A task holds two blocks and the k best of each row; what salted tasks find is merged by a window that keeps k before it shuffles.
    """
    spark = vectors.sparkSession
    steps = Steps(spark)
    v = F.transform("vector", lambda x: x.cast("double"))
    rows = vectors.select(F.col("id").cast("long").alias("id"), v.alias("v")).where(F.col("v").isNotNull() & F.forall("v", lambda x: F.coalesce(F.abs(x) < float("inf"), F.lit(False))))
    if metric == "cosine":
        length = F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x))
        rows = rows.withColumn("l", length).where("l > 0").select("id", F.transform("v", lambda x: x / F.col("l")).alias("v"))
    w = W.partitionBy("v").orderBy("id")
    rows = steps.written(rows.select("id", F.first("id").over(w).alias("rep"), F.row_number().over(w).alias("copy"), "v"), "rows")
    reps = rows.where("copy = 1").select("id", "v")
    n = reps.count()
    empty = spark.createDataFrame([], "id long, rank int, near long, score double")
    if n == 0:
        return empty
    dim = len(reps.first()["v"])
    block_rows = block_rows or max(1, BLOCK_BYTES // (8 * dim))
    sample = reps.orderBy(F.xxhash64("id"), "id").limit(min(MOST_PIVOTS, -(-2 * n // block_rows))).toArrow()
    pivots = _vectors(sample.column("v"))
    dealt = steps.written(reps.mapInArrow(_dealer(pivots), "id long, v array<double>, pivot long, far double"), "dealt")
    counts, radii = np.zeros(len(pivots), np.int64), np.zeros(len(pivots))
    for p, c, r in dealt.groupBy("pivot").agg(F.count("*"), F.max("far")).collect():  # a row for each pivot
        counts[p], radii[p] = c, r
    parts = F.element_at(F.array(*(F.lit(max(1, -(-int(c) // block_rows))) for c in counts)), (F.col("pivot") + 1).cast("int"))
    part = F.pmod(F.xxhash64("id"), parts.cast("long"))
    blocks = steps.written(dealt.withColumn("part", part).groupBy("pivot", "part").applyInArrow(_packed, "pivot long, part long, ids binary, v binary"), "blocks")

    def met(reach: np.ndarray | None) -> DataFrame:
        pairs = spark.range(len(pivots)).mapInArrow(_pairs(pivots, radii, counts, reach, k), "q long, t long")
        asks = blocks.select(F.col("pivot").alias("q"), F.col("part").alias("own"), "ids", "v").join(pairs.select("q").distinct(), "q", "left_semi")
        asks = asks.select("q", "own", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"), F.lit(0).alias("kind"), "ids", "v")
        owns = blocks.select(F.col("pivot").alias("q"), F.col("part").alias("own"))
        wanted = pairs.join(owns, "q").join(blocks.select(F.col("pivot").alias("t"), "part", "ids", "v"), "t")
        wanted = wanted.select("q", "own", F.pmod(F.xxhash64("t", "part"), F.lit(SALTS)).cast("int").alias("salt"), F.lit(1).alias("kind"), "ids", "v")
        work = asks.unionByName(wanted).repartition("q", "own", "salt").sortWithinPartitions("q", "own", "salt", "kind")
        work = work.select(F.concat_ws(":", "q", "own", "salt").alias("key"), "kind", "ids", "v")
        return work.mapInArrow(_searcher(dim, k, metric), "id long, near long, score double")

    best = W.partitionBy("id").orderBy(F.desc("score"), "near")
    first = steps.written(met(None), "found")
    kth = first.withColumn("r", F.row_number().over(best)).where(F.col("r") == k).select("id", "score")
    ends = dealt.select("id", "pivot").join(kth, "id", "left").groupBy("pivot").agg(F.min("score").alias("score"), F.bool_or(F.col("score").isNull()).alias("open"))
    reach = np.zeros(len(pivots))
    for p, score, is_open in ends.collect():  # a row for each pivot; a rounded score may be that of a farther row
        score = -np.inf if is_open else score - 10.0**-DIGITS
        reach[p] = np.inf if is_open else np.sqrt(max(0.0, 2 - 2 * score)) if metric == "cosine" else -score
    found = first.unionByName(met(reach)).withColumn("r", F.row_number().over(best)).where(F.col("r") <= k).select("id", "near", "score")
    # of each distinct vector the k + 1 smallest ids, as candidates of others and of its own copies
    listed = rows.where(F.col("copy") <= k + 1).select(F.col("rep").alias("near"), F.col("id").alias("other"))
    one = 1.0 if metric == "cosine" else 0.0
    own = rows.where("copy = 1").select("id", F.col("id").alias("near"), F.lit(one).alias("score"))
    each = found.unionByName(own).join(listed, "near").select("id", "other", "score")
    each = each.withColumn("r", F.row_number().over(W.partitionBy("id").orderBy(F.desc("score"), "other"))).where(F.col("r") <= k + 1)
    lists = each.groupBy("id").agg(F.sort_array(F.collect_list(F.struct((-F.col("score")).alias("less"), "other"))).alias("others")).withColumnRenamed("id", "rep")
    near = F.slice(F.filter("others", lambda x: x["other"] != F.col("id")), F.lit(1), F.lit(k))
    every = rows.select("id", "rep").join(lists, "rep").select("id", F.posexplode(near).alias("place", "x"))
    return every.select("id", (F.col("place") + 1).cast("int").alias("rank"), F.col("x.other").alias("near"), (-F.col("x.less")).alias("score"))


def preserved(graph: DataFrame, other: DataFrame) -> DataFrame:
    """(id, common, jaccard): how far two neighbour graphs (id, near) agree on each id that has neighbours in either."""
    near = lambda g, name: g.groupBy("id").agg(F.collect_set("near").alias(name))
    both = near(graph, "a").join(near(other, "b"), "id", "full").select("id", *(F.coalesce(c, F.array().cast("array<long>")).alias(c) for c in "ab"))
    common = F.size(F.array_intersect("a", "b"))
    return both.select("id", common.cast("long").alias("common"), (common / F.size(F.array_union("a", "b"))).alias("jaccard"))
