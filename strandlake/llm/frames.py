"""Small helpers on DataFrames that several operators share."""

from __future__ import annotations

import contextlib
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Links that one task settles (16 bytes each); more are settled by joins.
MOST_LINKS = 2_000_000
#: The setting for what a Python function gets at once, and its value in bounded_batches; Spark's own is 64 MB.
BATCH_BYTES, FEW_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch", 2 << 20


def shared_folder(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names, which executors share. Only a local master may do without the setting."""
    folder = spark.sparkContext.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if folder is None:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = tempfile.mkdtemp(prefix="checkpoint-")
        spark.sparkContext.setCheckpointDir(folder)
    return folder


def kept(df: DataFrame) -> DataFrame:
    """df, written as Parquet in the shared folder and read from there: its lineage ends, and a lost executor loses nothing.

    Columns that aren't read again are not read, and small tables come back in few partitions.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/kept-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def bounded_broadcast(df: DataFrame, rows: int, limit: int) -> DataFrame:
    """df with a broadcast hint if it has at most limit rows; else as it is, for a shuffled join."""
    return F.broadcast(df) if rows <= limit else df


@contextlib.contextmanager
def bounded_batches(spark: SparkSession) -> Iterator[None]:
    """What runs in it gives Python functions FEW_BYTES of rows at once, or one longer row, unless the session has a limit of its own.

    A batch is held by the executor's JVM, outside its heap, and by the Python worker, for each core. Only
    what is computed in it counts, not a DataFrame that is read later.
    """
    own = BATCH_BYTES in spark.conf.getAll
    if not own:
        spark.conf.set(BATCH_BYTES, FEW_BYTES)
    try:
        yield
    finally:
        if not own:
            spark.conf.unset(BATCH_BYTES)


def empty_like(spark: SparkSession, schema: str) -> DataFrame:
    return spark.createDataFrame([], schema)


def settle(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(node, root) of each node of links u-v that isn't its component's smallest, by pointer jumping."""
    nodes, at = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b = at[: len(u)], at[len(u) :]
    root = np.arange(len(nodes))
    while True:
        low = np.minimum(root[a], root[b])
        before = root.copy()
        # the smaller root of each link goes to both ends and to the roots they had
        for end in (a, b):
            np.minimum.at(root, before[end], low)
            np.minimum.at(root, end, low)
        while not np.array_equal(jumped := root[root], root):
            root = jumped
        if (root == before).all():
            some = root != np.arange(len(nodes))
            return nodes[some], nodes[root[some]]


def _settled_in_one(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    ends = [(x.column(0).to_numpy(), x.column(1).to_numpy()) for x in batches]
    if ends:
        node, root = settle(*(np.concatenate(x) for x in zip(*ends, strict=True)))
        yield pa.RecordBatch.from_arrays([pa.array(node, pa.int64()), pa.array(root, pa.int64())], ["node", "root"])


def components(links: DataFrame) -> DataFrame:
    """Connected components of links (a, b), as rows (node, root) for each node that is not its component's smallest.

    At most MOST_LINKS links, which take a known amount of memory, are settled in one task by pointer
    jumping. More alternate two steps that rewire each node's neighbours to the smallest of them,
    until the links are stars. Each step is a grouped minimum and a join, whose hot nodes adaptive
    execution splits; nothing is collected but the count of links and a checksum of them. Each pair of
    steps that changes anything lowers some node's neighbour, so it ends.
    """
    edges = kept(links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    if edges.count() <= MOST_LINKS:
        return kept(edges.repartition(1).mapInArrow(_settled_in_one, "node long, root long"))
    ways = lambda x, y: F.explode(F.array(F.struct(F.col(x).alias("u"), F.col(y).alias("v")), F.struct(F.col(y).alias("u"), F.col(x).alias("v")))).alias("way")
    seen = None
    while True:
        both = edges.select(ways("u", "v")).select("way.*")
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        pairs = large.join(least, "u")
        small = pairs.select(F.explode(F.array("u", "v")).alias("u"), F.col("m").alias("v"))
        edges = kept(small.where("u <> v").distinct())
        state = tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if state == seen:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
        seen = state
