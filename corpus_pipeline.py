"""A training corpus from documents: five stages, each on all that the one before it kept.

Every stage judges rows by their texts: what becomes of a row doesn't depend on others that happen to have
its id. All stages give no rows for an empty table, and keep texts as they are, however long.
"""

from __future__ import annotations

import operator
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandlake.llm.frames import bounded_broadcast, kept
from strandlake.llm.jaccard import MOST_IDS, jaccard_components
from strandlake.llm.mixing import curriculum
from strandlake.llm.sharding import pack_shards
from strandlake.llm.tiling import decontaminate
from strandlake.llm.toxicity import toxicity_scores

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def without(docs: DataFrame, gone: DataFrame) -> DataFrame:
    """docs without the rows that have the values of a row of gone in all its columns; these are broadcast only if they are few."""
    gone = kept(gone.distinct())
    few = bounded_broadcast(gone, gone.count(), MOST_IDS)
    same = [docs[c].eqNullSafe(few[c]) for c in gone.columns]
    return docs.join(few, reduce(operator.and_, same), "left_anti")


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents whose score is 0.5 or more.

    Each row is judged by its own text, repeated rows alike; a null or empty text has the score of no words
    and stays. Without labels all scores are 0.5, so a table of labels is needed.
    """
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return toxicity_scores(docs, labels, through=COLUMNS).where("predicted = 0").select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of five-word shingle sets of similarity 0.8 or more: that of the smallest id.

    Rows without any word, or with a null id, stay as they are. Where ids repeat, rows are numbered first and
    each stands for itself: of several rows of one component that repeat its smallest id, one stays, and rows of
    that id with other texts aren't touched.
    """
    known = docs.where("doc_id is not null")
    if known.groupBy("doc_id").count().where("count > 1").isEmpty():
        found = jaccard_components(known, words=5, percent=80)
        return without(docs, found.where("component_id <> doc_id").select("doc_id")).select(*COLUMNS)
    rows = kept(docs.withColumn("row", F.monotonically_increasing_id()))
    found = kept(jaccard_components(rows.where("doc_id is not null"), id_col="row", words=5, percent=80).where("n_shingles > 0").join(rows.select("row", "doc_id"), "row"))
    stays = found.groupBy("component_id").agg(F.min(F.struct("doc_id", "row")).alias("first")).select(F.col("first.row").alias("row"))
    return without(rows, found.select("row").join(stays, "row", "left_anti")).select(*COLUMNS)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the rows that hold a benchmark item, whatever their id; null and empty texts hold none, and repeated rows go together."""
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    keyed = docs.withColumn("key", F.unhex(F.md5(F.col("text").cast("binary"))))
    found = decontaminate(keyed.select(F.struct("doc_id", "key").alias("row"), "text"), benchmark, id_col="row")
    return without(keyed, found.select("row.doc_id", "row.key")).select(*COLUMNS)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix in training order: a row for each pass that takes a document.

    Null and wordless texts have no size and are never taken. The null source is a source. Rows that repeat an
    id are taken one by one, and ties of position go by the id's hash.
    """
    return curriculum(docs).select(*COLUMNS)


def sharding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each row's shard and its slot there. Equal texts stand together while a shard has room; null texts are one group."""
    return pack_shards(docs).select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot")


STAGES = [("toxicity", toxicity), ("near_duplicates", near_duplicates), ("decontamination", decontamination), ("mixing", mixing), ("sharding", sharding)]

#: Toxicity is a trained model, so no SQL gives these rows; tests/llm compares each stage with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The shards of what all stages keep of documents; an empty table of documents gives no rows."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = kept(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
