"""Main texts of web pages: site templates are found by counting subtrees per host, and removed with what is marked as no article.

Two scans of the pages. The first hashes the subtrees of each page and counts, in Spark, on how many pages of a host each
stands; subtrees on at least `share` of them, and `least` pages, are the host's template. The second takes the
article's text without them. Pages of a host that have the same article count once, so that copies of a page
don't make its text a template.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .frames import bounded_broadcast, kept
from .html_tree import article, digests, parse, removable, roots, unwanted

#: Subtrees of all hosts' templates that are broadcast; more are joined by shuffle.
MOST_BROADCAST = 500_000
#: Pages in a batch that comes back.
BATCH = 256
#: Stands for a page as a whole among its subtrees.
PAGE = 0

_HOST = r"^(?:[A-Za-z][A-Za-z0-9+.\-]*:)?//(?:[^/?#]*@)?(\[[^\]]*\]|[^/?#:]*)"


def host(url) -> F.col:
    """The lower-cased host of a URL, null where there is none."""
    return F.nullif(F.lower(F.regexp_extract(url, _HOST, 1)), F.lit(""))


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _subtrees(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(host, node, page): the digests of a page's subtrees that could be a template's, and PAGE; page is the digest of its article."""
    for batch in batches:
        hosts, nodes, pages = [], [], []
        for place, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            tree = parse(text.as_py() or "")
            gone, inside = unwanted(tree)
            own = digests(tree, gone)
            page = 0
            for i in sorted(roots(tree, gone)):
                page = hash((page, own[i]))  # of integers, so the same in every process
            found = {PAGE, *(_signed(own[i]) for i in range(1, len(own)) if own[i] and not gone[i] and removable(tree, i, inside))}
            hosts += [place] * len(found)
            nodes += found
            pages += [page] * len(found)
        yield pa.RecordBatch.from_arrays([pa.array(hosts, pa.int64()), pa.array(nodes, pa.int64()), pa.array(pages, pa.int64())], ["host", "node", "page"])


def templates(pages: DataFrame, least: int = 5, share: float = 0.3) -> DataFrame:
    """pages (host long, html) to one row for each host with a template: host, nodes (digests of subtrees).

    A host's subtrees are counted in two steps of a distinct count, which spread a host over all tasks. A template has at
    most 1 / share times as many subtrees as a page of the host has on average.
    """
    counts = pages.mapInArrow(_subtrees, "host long, node long, page long").groupBy("host", "node").agg(F.countDistinct("page").alias("n"))
    counts = kept(counts.where((F.col("node") == PAGE) | (F.col("n") >= least)))
    sizes = counts.where(F.col("node") == PAGE).select(F.col("host").alias("h"), F.col("n").alias("pages"))
    found = counts.where(F.col("node") != PAGE).join(sizes, F.col("host") == F.col("h")).where(F.col("n") >= F.lit(float(share)) * F.col("pages"))
    return found.groupBy("host").agg(F.collect_list("node").alias("nodes"))


def _extracted(names: list[str]):
    def texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for start in range(0, whole.num_rows, BATCH):
                batch = whole.slice(start, BATCH)
                out = []
                for page, nodes in zip(batch.column(2), batch.column(3), strict=True):
                    out.append(article(parse(page.as_py() or ""), {x % (1 << 64) for x in nodes.as_py() or ()}))
                sizes = pa.array([len(x) for x in out], pa.int64())
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([x.encode("utf-8", "replace").decode() for x in out], pa.string()), sizes], names)

    return texts


def main_texts(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", least: int = 5, share: float = 0.3) -> DataFrame:
    """Each page's id, url, text (its article, one block a line) and n_chars (code points).

    The article is the page's one article element, else its main element, all articles, or the body. Left out are menus, headers and
    footers of the page, sidebars, notices, adverts, forms, scripts, styles, hidden elements and readers' comments, by tag, role
    and names of class and id; and subtrees of the host's template: whole containers, outside of articles any block. A
    paragraph within an article is never a template by itself, however many pages hold it. Table cells and line breaks are white space within
    a block. White space is Unicode's, after character references are decoded.

    Every row is a page, also where ids or whole rows repeat. A null or empty page, or one without article, has the empty text. A
    page without host (a null or relative URL) has no template. Pages may break off anywhere, and be very long. Further
    columns don't matter, whatever their names. An empty table gives no rows.
    """
    rows = pages.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{url_col}`").cast("string").alias("url"), F.col(f"`{html_col}`").cast("string").alias("html"))
    key = F.when(host("url").isNotNull(), F.xxhash64(host("url")))
    own = kept(templates(rows.select(key.alias("host"), "html").where("host is not null"), least, share))
    own = bounded_broadcast(own.withColumnRenamed("host", "h"), own.agg(F.coalesce(F.sum(F.size("nodes")), F.lit(0))).first()[0], MOST_BROADCAST)
    # a page without host has a key of its own, so that these rows are spread where the join is a shuffle
    keyed = rows.withColumn("host", F.coalesce(key, F.xxhash64("html", "id")))
    joined = keyed.join(own, F.col("host") == F.col("h"), "left").select("id", "url", "html", F.when(key.isNotNull(), F.col("nodes")).alias("nodes"))
    kind = rows.schema["id"].dataType.simpleString()
    names = ["id", "url", "text", "n_chars"]
    found = joined.mapInArrow(_extracted(names), f"id {kind}, url string, text string, n_chars long")
    return found.select(F.col("id").alias(id_col), F.col("url").alias(url_col), "text", "n_chars")
