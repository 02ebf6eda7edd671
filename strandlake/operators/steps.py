"""Steps of operators that go round by round: tables that are written once and read by several later jobs."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; only a local session that names none gets one of its own."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if folder is None:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="steps-")
        spark.sparkContext.setCheckpointDir(folder)
    return folder


class Steps:
    """Tables of one operator in the shared folder. A loop drops those of earlier rounds, so they don't add up."""

    def __init__(self, spark: SparkSession):
        self.spark, self.folder, self.paths = spark, f"{shared_folder(spark)}/steps-{uuid.uuid4().hex}", {}

    def written(self, df: DataFrame, name: str) -> DataFrame:
        """df, written as Parquet and read from there: its lineage ends, and a lost executor loses nothing."""
        path = f"{self.folder}/{name}-{uuid.uuid4().hex}"
        df.write.parquet(path)
        self.paths[name] = [*self.paths.get(name, []), path]
        return self.spark.read.schema(df.schema).parquet(path)

    def drop_before_last(self, name: str) -> None:
        """Deletes all tables of this name but the last one; nothing may read them any more."""
        jvm, conf = self.spark._jvm, self.spark._jsparkSession.sessionState().newHadoopConf()
        *old, last = self.paths.get(name, [None])
        for path in old:
            where = jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(conf).delete(where, True)
        self.paths[name] = [last] if last else []


def cells_of(df: DataFrame, column: str, n: int, shift: float = 0.0, error: float = 0.1):
    """(number of the cell, cuts): n ranges of about as many values, cut at approximate quantiles, which alone the driver sees.

    The ranks of cuts are off by error cells at most. shift moves all cuts up by so many cells.
    """
    cuts = sorted(set(df.approxQuantile(column, [(i + shift) / n for i in range(1 if shift == 0 else 0, n)], error / n))) if n > 1 else []
    # a lookup in a sorted literal array: the first cut above the value
    at = F.size(F.filter(F.array(*map(F.lit, cuts)), lambda c: c < F.col(column))) if cuts else F.lit(0)
    return at, cuts


def last_at_or_before(points: DataFrame, steps: DataFrame, value: str, n: int = 64) -> DataFrame:
    """points (x distinct, ..) with the value column of the last row of steps (x distinct, value) at or before x, or of the first step where none is.

    An as-of join by ranges: points and steps are cut into n cells, each is one sorted window, and each cell starts with the
    last step of the cells before it. No steps give nulls.
    """
    at, cuts = cells_of(points, "x", n)
    own = steps.select("x", F.col(value).alias("_v")).withColumn("_cell", at)
    lasts = own.groupBy("_cell").agg(F.max(F.struct("x", "_v")).alias("last"))
    cells = points.sparkSession.range(len(cuts) + 1).select(F.col("id").cast("int").alias("_cell"))
    carry = F.max("last").over(W.orderBy("_cell").rowsBetween(W.unboundedPreceding, -1))["_v"]  # a row for each cell
    first = own.agg(F.min_by("_v", "x").alias("_first"))
    before = cells.join(F.broadcast(lasts), "_cell", "left").select("_cell", carry.alias("_carry")).join(F.broadcast(first))
    both = points.withColumn("_cell", at).withColumn("_step", F.lit(False)).unionByName(own.withColumn("_step", F.lit(True)), allowMissingColumns=True)
    order = W.partitionBy("_cell").orderBy("x", F.desc("_step")).rowsBetween(W.unboundedPreceding, 0)
    seen = both.withColumn("_last", F.last("_v", ignorenulls=True).over(order)).where(~F.col("_step"))
    return seen.join(F.broadcast(before), "_cell").select(*points.columns, F.coalesce("_last", "_carry", "_first").alias(value))
