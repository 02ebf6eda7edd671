"""N-gram Jaccard join by grouped prefixes, and the components of its links.

A document is the set of its k-word shingles. Two link if percent of their union is common to
both. Shingles have one global order: those that are frequent in prefixes come last, all others
by hash. Two linked sets share COMMON shingles (or all that they must share, if fewer) within their
first n - ceil(percent * n) + COMMON ones, the prefix. Sets that are equal are one class. Classes of
equal prefix and size form a group, and only groups have entries in the prefix index. Pairs are
filtered by size, by how many shingles each has alone, by what they share in the prefix and by what can
still follow; they are expanded to classes, and these are verified on whole texts.

For a shingle of many groups the index does not emit all pairs at first: each entry meets one center
of its size band, the group with most such shingles in its prefix, as a text has that others were
copied from. Components follow from what is verified. Only entries that are still in different
components meet each other then. Those that were compared with one center, the hub, don't meet by
their shingles, nearly all of which they share, but by how they differ from the hub: a second prefix
join, of these differences. So a cluster of n near copies costs about n verifications, and no link
between different components is lost.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .frames import bounded_batches, bounded_broadcast, components, kept
from .words import shingle_sets

#: A shingle in more prefixes than this comes last in the order; of these the most frequent count, as many as are broadcast.
FREQUENT, MOST_FREQUENT = 48, 2_000_000
#: Shingles that the prefixes of two linked sets have in common; entries from which on a shingle has a center.
COMMON, CENTERED = 3, 16
#: Ids (8 bytes each) and centers (24 bytes) that are broadcast at most; beyond it those joins are shuffled.
MOST_IDS = 2_000_000


def prefix_length(n: int, percent: int) -> int:
    """How many first shingles of a set of n share COMMON with any linked set's prefix."""
    return min(n, n - -(-percent * n // 100) + COMMON)


def _signatures(k: int, percent: int, frequent=None, wide: bool = False):
    """mapInArrow: id, n, f (how many shingles are frequent), sig (of the whole set), key (of the prefix), prefix. wide: the prefix and some more, for the counts."""

    def run(batches):
        last = frequent.value if frequent is not None else np.zeros(0, np.uint64)
        for batch in batches:
            ns, fs, sigs, keys, prefixes = [], [], [], [], []
            for found in shingle_sets(batch.column(1), k):
                n = len(found)
                p = prefix_length(n, percent)
                if wide:
                    p = min(n, p + n // 16 + 4)
                first, f = found[:p], 0
                if len(last):
                    at = np.minimum(np.searchsorted(last, found), len(last) - 1)
                    hot = last[at] == found
                    if hot.any():
                        first, f = np.concatenate([found[~hot], found[hot]])[:p], int(hot.sum())
                ns.append(n)
                fs.append(f)
                sigs.append(hashlib.md5(found.tobytes()).digest())
                keys.append(hashlib.md5(first.tobytes()).digest())
                prefixes.append(first.view(np.int64))
            lengths = np.cumsum([0, *map(len, prefixes)], dtype=np.int32)
            flat = np.concatenate(prefixes) if prefixes else np.zeros(0, np.int64)
            arrays = pa.ListArray.from_arrays(pa.array(lengths), pa.array(flat, pa.int64()))
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), pa.array(ns, pa.int64()), pa.array(fs, pa.int64()), pa.array(sigs, pa.binary()), pa.array(keys, pa.binary()), arrays], ["id", "n", "f", "sig", "key", "prefix"])

    return run


_SIGNATURE = "id long, n long, f long, sig binary, key binary, prefix array<long>"


def _frequent(pairs: DataFrame, k: int, percent: int):
    """The shingles of more than FREQUENT prefixes, sorted, as a broadcast of at most MOST_FREQUENT * 8 bytes."""

    def shingles(batches):
        of = _signatures(k, percent, wide=True)
        for batch in of(batches):
            values, counts = np.unique(batch.column(5).flatten().to_numpy(zero_copy_only=False), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(values, pa.int64()), pa.array(counts, pa.int64())], ["s", "c"])

    counts = pairs.mapInArrow(shingles, "s long, c long").groupBy("s").agg(F.sum("c").alias("c")).where(F.col("c") > FREQUENT)
    top = counts.orderBy(F.desc("c"), "s").limit(MOST_FREQUENT).select("s").toArrow().column(0).to_numpy()
    return pairs.sparkSession.sparkContext.broadcast(np.sort(top.astype(np.int64).view(np.uint64)))


def compared(pairs: DataFrame, texts: DataFrame, k: int, percent: int) -> DataFrame:
    """Pairs (a, b) of ids, compared on their whole texts (id, text).

    Gives a, b, the sizes n_a and n_b of their sets, whether they link, and diff: what only one of them
    has, or null if that is more than a has.
    """

    def run(batches):
        for batch in batches:
            rows = []
            for x, y in zip(shingle_sets(batch.column(2), k), shingle_sets(batch.column(3), k), strict=True):
                only = np.setxor1d(x, y, assume_unique=True)
                both = (len(x) + len(y) - len(only)) // 2
                linked = both > 0 and 100 * both >= percent * (len(x) + len(y) - both)
                rows.append((len(x), len(y), linked, only.view(np.int64) if len(only) <= len(x) else None))
            n_a, n_b, linked, diff = zip(*rows, strict=True) if rows else ((), (), (), ())
            columns = [batch.column(0), batch.column(1), pa.array(n_a, pa.int64()), pa.array(n_b, pa.int64()), pa.array(linked, pa.bool_()), pa.array(diff, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(columns, ["a", "b", "n_a", "n_b", "linked", "diff"])

    pairs = kept(pairs.where("a <> b").select("a", "b").distinct())
    ids = kept(pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct())
    some = texts.join(bounded_broadcast(ids, ids.count(), MOST_IDS), "id", "left_semi")
    left, right = (some.select(F.col("id").alias(c), F.col("text").alias(f"text_{c}")) for c in "ab")
    return pairs.join(left, "a").join(right, "b").select("a", "b", "text_a", "text_b").mapInArrow(run, "a long, b long, n_a long, n_b long, linked boolean, diff array<long>")


def links(found: DataFrame) -> DataFrame:
    """Of compared pairs those that link, the smaller id first, each once."""
    return found.where("linked").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def hubs(found: DataFrame) -> DataFrame:
    """(cid, hub, votes, n, hub_n, diff, d): of the ids that a was compared with and is near to, the one that most are near to.

    An id with several texts has no one difference, and so no hub.
    """
    near = found.groupBy("a", "b").agg(F.min("diff").alias("diff"), (F.every(F.col("diff").isNotNull()) & (F.min("diff") == F.max("diff"))).alias("one"), F.max("n_a").alias("n"), F.max("n_b").alias("hub_n")).where("one")
    votes = near.groupBy("b").agg(F.count("*").alias("votes"))
    best = near.join(votes, "b").groupBy("a").agg(F.max(F.struct("votes", -F.col("b"), F.struct("b", "n", "hub_n", "diff"))).alias("best"))
    chosen = best.select(F.col("a").alias("cid"), "best.votes", F.col("best.col3.*"))
    return chosen.select("cid", F.col("b").alias("hub"), "votes", "n", "hub_n", "diff", F.size("diff").alias("d"))


def around_hubs(near: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) near one hub, of different roots, that link: a prefix join of their differences to the hub.

    near is what hubs gives, with root. With differences X and Y two sets differ in |X| + |Y| - 2 |X and Y|
    shingles, and link if that is at most a share of both sizes. Unless both link with the hub, and so
    have one root, X and Y then have some in common; how many follows from their sizes. What one has alone counts
    for nothing, so edits of its own make a set's prefix shorter, and near copies that each were
    edited elsewhere hardly meet.
    """
    share = (100 - percent) / (100 + percent)
    bounds = near.groupBy("hub").agg(F.min("root").alias("lo"), F.max("root").alias("hi"), F.max("n").alias("most_n")).where("lo < hi").select("hub", "most_n")
    some = kept(near.join(bounds, "hub"))
    every = some.select("hub", "cid", "n", "hub_n", "most_n", "root", "d", F.explode("diff").alias("e"))
    common = every.groupBy("hub", "e").agg(F.count("*").alias("c")).where("c > 1")
    own = W.partitionBy("cid")
    ranked = every.join(common, ["hub", "e"]).select("*", F.row_number().over(own.orderBy("c", "e")).alias("i"), F.count("*").over(own).alias("size"))
    at_least = lambda x: F.greatest(F.lit(1), F.ceil(x - 1e-9))
    with_more = at_least(F.greatest(F.col("d") - share / 2 * (F.col("n") + F.least(F.col("most_n").cast("double"), 100 / percent * F.col("n"))), (1 - share) / 2 * F.col("d")))
    with_less = at_least((F.col("d") + 1 - share - share * (F.col("hub_n") + F.col("n"))) / 2)
    ranked = kept(ranked.select("hub", "e", "cid", "n", "d", "root", "i", "size", with_more.alias("with_more"), with_less.alias("with_less")))
    side = lambda c: (F.col(x).alias(f"{x}_{c}") for x in ("cid", "n", "d", "root", "i", "size"))
    x = ranked.where("i <= size - with_more + 1").select("hub", "e", *side("a"))
    y = ranked.where("i <= size - with_less + 1").select("hub", "e", *side("b"))
    least = F.ceil(percent * (F.col("n_a") + F.col("n_b")) / F.lit(100.0 + percent) - 1e-9)
    need = F.ceil((F.col("d_a") + F.col("d_b") - (F.col("n_a") + F.col("n_b") - 2 * least)) / 2)
    less = (F.col("d_a") < F.col("d_b")) | ((F.col("d_a") == F.col("d_b")) & (F.col("cid_a") < F.col("cid_b")))
    room = F.least("i_a", "i_b") + F.least(F.col("size_a") - F.col("i_a"), F.col("size_b") - F.col("i_b"))
    met = x.join(y, ["hub", "e"]).where(less & (F.col("root_a") != F.col("root_b")) & (room >= need))
    met = met.select(F.col("cid_a").alias("a"), F.col("cid_b").alias("b"), need.alias("need")).distinct()
    diffs = some.select("cid", "diff")
    both = met.join(diffs.select(F.col("cid").alias("a"), F.col("diff").alias("diff_a")), "a").join(diffs.select(F.col("cid").alias("b"), F.col("diff").alias("diff_b")), "b")
    return both.where(F.size(F.array_intersect("diff_a", "diff_b")) >= F.col("need")).select("a", "b")


def jaccard_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, percent: int = 80) -> DataFrame:
    """One row per row of docs: id, n_shingles, class_id (smallest id of an equal set), component_id (smallest id that links reach).

    A null or wordless text has no shingles and links with nothing, not with its like. A text of fewer
    words than a shingle is one shingle. A row with a null id is counted and has neither class nor
    component. Rows that repeat an id stay rows; with different texts, each joins its own text's component.
    An empty table gives no rows; other columns of docs are not read.
    """
    # all Python functions run before the result is returned, which only joins tables that are kept
    with bounded_batches(docs.sparkSession):
        return _components_of(docs, id_col, text_col, words, percent)


def _components_of(docs: DataFrame, id_col: str, text_col: str, words: int, percent: int) -> DataFrame:
    text = F.col(text_col).cast("string")
    pairs = docs.select(F.col(id_col).cast("long").alias("id"), text.alias("text"))
    signed = pairs.mapInArrow(_signatures(words, percent, _frequent(pairs, words, percent)), _SIGNATURE)
    # prefixes are neither written nor shuffled but once, to their groups; a second scan is cheaper
    rows = kept(signed.drop("prefix"))
    usable = F.col("id").isNotNull() & (F.col("n") > 0)
    classes = kept(rows.where(usable).groupBy("sig", "n").agg(F.min("id").alias("cid"), F.first("f").alias("f"), F.first("key").alias("key")))
    groups = classes.groupBy("key", "n", "f").agg(F.min("cid").alias("gid"), F.count("*").alias("members")).where("members > 1")
    members = kept(classes.join(groups, ["key", "n", "f"]).select("cid", "gid", "n", "members").where("cid <> gid"))
    sizes = members.groupBy("gid").agg(F.max("members").alias("members"))
    groups = signed.where(usable).groupBy("key", "n", "f").agg(F.min("id").alias("gid"), F.first("prefix").alias("prefix"))

    # the index: an entry is a shingle in the prefix of a group; those of one class go at once
    entries = groups.join(sizes, "gid", "left").select("gid", *(F.col(c).cast("int").alias(c) for c in ("n", "f")), F.coalesce("members", F.lit(1)).alias("members"), F.size("prefix").alias("p"), F.posexplode("prefix").alias("i", "s"))
    band = F.floor(F.log(F.col("n").cast("double")) / math.log(100 / percent) + 1e-9)
    shared = entries.groupBy("s").agg(F.sum("members").alias("c"), F.count("*").alias("groups")).where("c > 1").select("s", (F.col("groups") > CENTERED).alias("many"))
    entries = kept(entries.join(shared.hint("merge"), "s").select("s", "gid", "n", "f", "i", "p", "many", band.alias("band")))
    # what a set shares with another is at most its size less the shingles that it alone has; most sets end here
    most = entries.groupBy("gid").agg((F.max("n") - F.max("p") + F.count("*")).alias("most"), F.max("n").alias("size"))
    entries = kept(entries.join(most.where(100 * F.col("most") >= percent * F.col("size")).select("gid", "most"), "gid"))

    # first links: a group's members with its smallest, entries of many with the center of their band and the band below
    many = entries.where("many")
    many = many.join(many.groupBy("gid").agg((-F.count("*")).alias("rank")), "gid")
    centers = kept(many.groupBy("s", "band").agg(F.min(F.struct("rank", "gid")).alias("top")).select("s", "band", F.col("top.gid").alias("to")))
    centers = bounded_broadcast(centers, centers.count(), MOST_IDS)
    near = many.select("s", "gid", F.explode(F.array(F.col("band"), F.col("band") - 1)).alias("band")).join(centers, ["s", "band"])
    near = near.where("gid <> to").groupBy("gid", "to").agg(F.count("*").alias("c")).where(F.col("c") >= COMMON)
    stars = near.select(F.col("gid").alias("a"), F.col("to").alias("b")).unionByName(members.select(F.col("cid").alias("a"), F.col("gid").alias("b")))
    found = kept(compared(stars, pairs, words, percent))
    # what is near a lesser hub, is compared with that hub's own as well, so that a cluster has one
    lesser = kept(hubs(found).select("cid", "hub", "votes"))
    greater = lesser.select(F.col("cid").alias("hub"), F.col("hub").alias("up"), F.col("votes").alias("more"))
    up = lesser.join(greater, "hub").where("more > votes").select(F.col("cid").alias("a"), F.col("up").alias("b"))
    found = kept(found.unionByName(compared(up.join(found.select("a", "b"), ["a", "b"], "left_anti"), pairs, words, percent)))
    first = kept(links(found))
    roots = components(first)
    rooted = lambda df: df.join(roots.withColumnRenamed("node", "cid"), "cid", "left").withColumn("root", F.coalesce("root", "cid"))
    near = kept(rooted(hubs(found)))

    # then the entries of all classes that are still in different components of one shingle or one group; those near one hub meet by their differences
    spread = entries.join(members.select("gid", "cid"), "gid").select("s", "cid", "n", "f", "p", "i", "most")
    every = rooted(entries.select("s", F.col("gid").alias("cid"), "n", "f", "p", "i", "most").unionByName(spread))
    of_hub = near.select("cid", "hub").unionByName(near.select(F.col("hub").alias("cid")).distinct().join(near.select("cid"), "cid", "left_anti").withColumn("hub", F.col("cid")))
    every = every.join(of_hub, "cid", "left")
    whose = F.coalesce("hub", "cid")
    mixed = every.groupBy("s").agg(F.min("root").alias("lo"), F.max("root").alias("hi"), F.min(whose).alias("one"), F.max(whose).alias("other")).where("lo < hi and one < other").select("s")
    every = kept(every.join(mixed, "s"))
    x, y = (every.select("s", *(F.col(c).alias(f"{c}_{side}") for c in ("cid", "n", "f", "p", "i", "most", "root", "hub"))) for side in "ab")
    least = F.ceil(percent * (F.col("n_a") + F.col("n_b")) / F.lit(100.0 + percent) - 1e-9)
    # sets that have too few frequent shingles must share others as well, and meet there; of those all others are in the prefix
    rare = F.least("f_a", "f_b") < least
    frequent_one = (F.col("i_a") >= F.col("n_a") - F.col("f_a")) & (F.col("i_b") >= F.col("n_b") - F.col("f_b"))
    sized = 100 * F.least("n_a", "n_b") >= percent * F.greatest("n_a", "n_b")
    may = ~(frequent_one & rare) & (F.least("most_a", "most_b") >= least) & (F.col("root_a") != F.col("root_b")) & sized
    alone = x.where("hub_a is null").join(y, "s").where(may & (F.col("hub_b").isNotNull() | (F.col("cid_a") < F.col("cid_b"))))
    of_s = kept(every.where("hub is not null").select("s", "hub").distinct())
    other = of_s.select("s", F.col("hub").alias("hub_a")).join(of_s.select("s", F.col("hub").alias("hub_b")), "s").where("hub_a < hub_b")
    across = other.join(x, ["s", "hub_a"]).join(y, ["s", "hub_b"]).where(may)
    met = alone.unionByName(across)
    met = met.groupBy(F.col("cid_a").alias("a"), F.col("cid_b").alias("b"), "n_a", "n_b", "f_a", "f_b", "p_a", "p_b").agg(F.count("*").alias("c"), F.max("i_a").alias("i_a"), F.max("i_b").alias("i_b"))
    room = F.least(F.col("n_a") - F.col("i_a") - 1, F.col("n_b") - F.col("i_b") - 1)
    seen = rare & (F.col("n_a") - F.col("f_a") <= F.col("p_a")) & (F.col("n_b") - F.col("f_b") <= F.col("p_b"))
    enough = (F.col("c") >= F.least(F.lit(COMMON), least)) & (F.col("c") + room >= least)
    late = met.where(F.when(seen, F.col("c") + F.least("f_a", "f_b") >= least).otherwise(enough)).select("a", "b").unionByName(around_hubs(near, percent))
    late = late.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).join(first, ["a", "b"], "left_anti")
    second = kept(links(compared(late, pairs, words, percent)))
    roots = components(first.unionByName(second)) if second.take(1) else roots

    of = classes.select("sig", "cid").join(roots.withColumnRenamed("node", "cid"), "cid", "left").select("sig", F.col("cid").alias("class_id"), F.coalesce("root", "cid").alias("component_id"))
    out = rows.select("id", "n", "sig").join(of, "sig", "left")
    alone = F.col("n") == 0
    return out.select(
        F.col("id").alias(id_col),
        F.col("n").alias("n_shingles"),
        *(F.when(F.col("id").isNotNull(), F.when(alone, F.col("id")).otherwise(F.col(c))).alias(c) for c in ("class_id", "component_id")),
    )
