"""Ranked lexical search: each query's best documents, by integer impacts that don't depend on how documents are dealt out.

Documents are searched in shards: a task cuts its texts into runs of SHARD_BYTES, and each run becomes postings in CSR form
(for each term the places of its documents, with one integer impact each). A query adds its terms' impacts one term at a
time into an array over the shard's documents, and its best are cut out with argpartition; of those that tie with the last
one the smallest ids are taken. The shards' best are merged by Spark, which keeps k a query in each task before it shuffles.

Impacts need three figures of the whole corpus (documents, terms, documents of each query term), which an earlier scan
sums up; only the queries' vocabulary is counted and posted, so nothing that grows with the corpus is broadcast or kept.

A term is a run of characters other than ASCII signs and white space, with A-Z lower-cased. Terms are compared by 64-bit
hashes (see words).
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .frames import kept
from .words import byte_chunks, hashed

#: Bytes of text in a shard; a longer text is a shard of its own.
SHARD_BYTES = 8 << 20
#: Distinct terms of the queries of one block; the documents are scanned twice for each block. A query of more terms is a block of its own.
BLOCK_TERMS = 1_000_000
#: What the two counts of the whole corpus stand under, beside the terms' numbers.
DOCUMENTS, TERMS = -1, -2

_BETWEEN = np.zeros(256, bool)
_BETWEEN[:128] = True
for _from, _to in ("09", "AZ", "az"):
    _BETWEEN[ord(_from) : ord(_to) + 1] = False


def _query_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(item, term, times): how often each query has each of its terms."""
    for batch in batches:
        keys = batch.column(0).to_numpy()
        for start, texts in byte_chunks(batch.column(1)):
            terms, first = hashed(texts, _BETWEEN)
            for i, (a, b) in enumerate(zip(first[:-1].tolist(), first[1:].tolist(), strict=True)):
                own, times = np.unique(terms[a:b], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(own), keys[start + i])), pa.array(own.view(np.int64)), pa.array(times.astype(np.int64))], ["item", "term", "times"])


class _Vocabulary:
    """The sorted hashes of the queries' terms, with a small table that most other words fail at once."""

    def __init__(self, terms: np.ndarray):
        self.terms = terms
        self.mask = np.uint64((1 << max(16, (16 * len(terms)).bit_length())) - 1)
        self.some = np.zeros(int(self.mask) + 1, bool)
        self.some[terms & self.mask] = True

    def postings(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """term, document and tf of each posting, sorted by term and document, and the number of all terms of each document."""
        words, first = hashed(texts, _BETWEEN)
        n = np.diff(first)
        at = np.flatnonzero(self.some[words & self.mask])
        term = np.searchsorted(self.terms, words[at])
        term[term == len(self.terms)] = 0
        hit = self.terms[term] == words[at]
        at, term = at[hit], term[hit]
        document = np.searchsorted(first, at, "right") - 1
        pairs, tf = np.unique(term * np.int64(len(n)) + document, return_counts=True)
        return pairs // max(len(n), 1), pairs % max(len(n), 1), tf, n


def counter(terms: np.ndarray):
    """A function that sums up, for each task, the documents that hold each term, all documents with a term and all their terms."""

    def counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, df, documents, every = _Vocabulary(terms), np.zeros(len(terms), np.int64), 0, 0
        for batch in batches:
            for _, texts in byte_chunks(batch.column(0)):
                term, _, _, n = known.postings(texts)
                df += np.bincount(term, minlength=len(df))
                documents, every = documents + int((n > 0).sum()), every + int(n.sum())
        some = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(some, [DOCUMENTS, TERMS])), pa.array(np.append(df[some], [documents, every]))], ["term", "n"])

    return counts


def impacts(tf: np.ndarray, n: np.ndarray, documents: int, every: int) -> np.ndarray:
    """What a term that occurs tf times in a document of n terms adds to it, before its weight: at most 1,000,000."""
    if len(n) and 75 * documents * int(n.max()) < 1 << 63:
        m = 25 + 75 * n.astype(np.int64) * documents // every
    else:
        m = np.array([25 + 75 * int(x) * documents // every for x in n], np.int64)
    return 1_000_000_000 * tf // (1000 * tf + 8 * m)


def best(scores: np.ndarray, ids: np.ndarray, null: np.ndarray, k: int) -> np.ndarray:
    """The places of the k highest scores above 0, equal ones by id, null ids last."""
    some = np.flatnonzero(scores > 0)
    if len(some) > k:
        own = scores[some]
        least = own[np.argpartition(-own, k - 1)[k - 1]]
        sure, tied = some[own > least], some[own == least]
        some = np.concatenate([sure, tied[np.lexsort((ids[tied], null[tied]))[: k - len(sure)]]])
    return some[np.lexsort((ids[some], null[some], -scores[some]))]


def searcher(terms: np.ndarray, weights: np.ndarray, documents: int, every: int, items: np.ndarray, first: np.ndarray, own: np.ndarray, times: np.ndarray, k: int):
    """A function that finds the k best documents of each shard for each item; item i has the terms own[first[i]:first[i + 1]]."""

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _Vocabulary(terms)
        for batch in batches:
            null = np.asarray(batch.column(0).is_null())
            ids = batch.column(0).fill_null(0).to_numpy()
            for start, texts in byte_chunks(batch.column(1), SHARD_BYTES):
                term, document, tf, n = known.postings(texts)
                added = impacts(tf, n[document], documents, every) * weights[term]
                begins = np.searchsorted(term, np.arange(len(terms) + 1))
                there, absent = ids[start : start + len(texts)], null[start : start + len(texts)]
                out: list[tuple] = []
                for i, item in enumerate(items.tolist()):
                    scores = np.zeros(len(n), np.int64)
                    for t, often in zip(own[first[i] : first[i + 1]].tolist(), times[first[i] : first[i + 1]].tolist(), strict=True):
                        # a document has one posting of a term, so places don't repeat
                        scores[document[begins[t] : begins[t + 1]]] += often * added[begins[t] : begins[t + 1]]
                    top = best(scores, there, absent, k)
                    out.append((np.full(len(top), item), there[top], absent[top], scores[top]))
                item, doc, gone, score = (np.concatenate(x) for x in zip(*out, strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(item), pa.array(doc, mask=gone), pa.array(score)], ["item", "doc", "score"])

    return found


def _blocks(terms: DataFrame) -> DataFrame:
    """terms with a block, so that blocks hold at most BLOCK_TERMS of them or one query alone."""
    sizes = kept(terms.groupBy("item").agg(F.count("*").alias("size")))
    total = sizes.agg(F.sum("size")).first()[0] or 0
    n = -(-total // BLOCK_TERMS)
    while n > 1:
        blocks = sizes.groupBy(F.expr(f"pmod(xxhash64(item), {n})").alias("block")).agg(F.sum("size").alias("size"), F.count("*").alias("items"))
        if blocks.where(f"items > 1 and size > {BLOCK_TERMS}").isEmpty():
            break
        n *= 2
    return terms.withColumn("block", F.expr(f"pmod(xxhash64(item), {max(n, 1)})"))


def ranked_search(docs: DataFrame, queries: DataFrame, k: int = 10, id_col: str = "doc_id", text_col: str = "text", query_id_col: str = "item_id", query_text_col: str = "text") -> DataFrame:
    """The k best rows of docs for each row of queries: query id, rank (from 1), doc id, score.

    A term of a query weighs w = floor(1000 * ln((2N + 2) / (2df + 1))): N documents with terms, df of them with this one. A document
    scores the sum of w * (10**9 * tf div (1000 * tf + 8 * m)) over the query's terms, repeats included, with m = 25 + 75 * n * N div L:
    n its own terms, L those of all documents. Scores are whole numbers, so ties are exact; they go by id, null ids last.
    Only scores above 0 count, so a query without a term of the corpus, a null or an empty one has no rows.

    Ids of docs are integers. Every row is a document, and every row of queries a query, whatever ids repeat. Null
    texts have no term; whole texts are read, however long. Other columns don't matter. Empty tables give no rows.
    """
    named = kept(queries.select(F.monotonically_increasing_id().alias("item"), F.col(f"`{query_id_col}`").alias("id"), F.col(f"`{query_text_col}`").cast("string").alias("text")))
    terms = kept(_blocks(kept(named.select("item", "text").mapInArrow(_query_terms, "item long, term long, times long"))))
    texts = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    parts = []
    for (block,) in terms.select("block").distinct().orderBy("block").collect():
        rows = terms.where(F.col("block") == block).select("item", "term", "times").toArrow()  # at most BLOCK_TERMS rows, or one query's
        item, term, times = (rows.column(i).to_numpy() for i in range(3))
        order = np.argsort(item, kind="stable")
        items, first = np.unique(item[order], return_index=True)
        vocabulary, own = np.unique(term.view(np.uint64)[order], return_inverse=True)
        counts = texts.select("text").mapInArrow(counter(vocabulary), "term long, n long").groupBy("term").agg(F.sum("n").alias("n"))
        counts = {int(t): int(n) for t, n in counts.collect()}  # one row for each term of the block
        documents, every = counts.get(DOCUMENTS, 0), counts.get(TERMS, 0)
        df = np.array([counts.get(t, 0) for t in range(len(vocabulary))], np.int64)
        weights = np.floor(1000 * np.log((2 * documents + 2) / (2 * df + 1))).astype(np.int64)
        find = searcher(vocabulary, weights, documents, every, items, np.append(first, len(item)), own, times[order], k)
        parts.append(texts.mapInArrow(find, "item long, doc long, score long"))
    found = reduce(DataFrame.unionAll, parts) if parts else docs.sparkSession.createDataFrame([], "item long, doc long, score long")
    rank = F.row_number().over(W.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc")))
    top = found.withColumn("rank", rank).where(F.col("rank") <= k)
    return top.join(named.select("item", "id"), "item").select(F.col("id").alias(query_id_col), "rank", F.col("doc").alias(id_col if id_col != query_id_col else f"found_{id_col}"), "score")
