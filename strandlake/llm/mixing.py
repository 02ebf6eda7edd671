"""Mixing sources to target weights along a curriculum whose weights vary over time.

Sources share `share` of all words by weight; a target stops at `most` times its source's words, and the
excess goes to the others by weight. A source's documents have one order, by a hash of their id,
and their words stand on one line after another, pass after pass, up to the target: so a document is taken
once for each pass that reaches it, and partly where the target ends within it.

When a source is trained on follows its schedule: its rate grows linearly from 1 - slope to 1 + slope over
the run (time 0 to 1). Integrated, the demand up to time t is target * ((1 - slope) * t + slope * t**2);
inverting this for the cumulative words before a document gives its training position. The demand of all sources up
to that time, of all targets together, is the share of the mix's words that come before it: so at any time each source
has the part of the next words that its rate has of all rates. Rows are sorted into this order by ranges.

Everything is built from grouped sums and windows. The running sum over a source's documents goes by cells
of the hash: sums of cells first, then within one cell, so no task holds a source.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .frames import kept

#: Leading hex digits of the key that make a cell, so a source has 4096; each is a window of its own.
CELL_DIGITS = 3


def source_targets(sources: DataFrame, weights: tuple[float, ...] = (5, 2, 1), share: float = 1.5, most: float = 2.0) -> DataFrame:
    """sources (source, source_size) with weight, slope, target, and flat and bent of all sources. By code point, null last, weights repeat.

    Sorted by most * size / weight, the first few sources are full; the level at which the others stand
    is the one at which all targets add up to share of all words, or every source is full. Binary strings
    compare by bytes, as code points do. The demand of all sources up to time t is flat * t + bent * t**2.
    """
    weight = F.element_at(F.array(*(F.lit(float(x)) for x in weights)), (F.pmod("place", F.lit(len(weights))) + 1).cast("int"))
    some = sources.withColumn("place", F.expr("row_number() over (order by source is null, cast(source as binary)) - 1")).withColumn("weight", weight)
    some = some.withColumn("cap", F.lit(float(most)) * F.col("source_size")).withColumn("ratio", F.col("cap") / F.col("weight"))
    some = some.selectExpr(
        "*",
        "coalesce(sum(cap) over (order by ratio, place rows between unbounded preceding and 1 preceding), 0D) as full",
        "sum(weight) over (order by ratio, place rows between current row and unbounded following) as open",
        "sum(source_size) over () as words",
    )
    # the level if this source is the first that isn't full; the smallest such level that keeps it from its cap holds
    level = (F.lit(float(share)) * F.col("words") - F.col("full")) / F.col("open")
    some = some.withColumn("level", level).selectExpr("*", "min(case when level <= ratio then struct(ratio, place, level) end) over () as first")
    slope = F.element_at(F.array(F.lit(-0.5), F.lit(0.0), F.lit(0.5)), (F.pmod("place", F.lit(3)) + 1).cast("int"))
    target = F.when(F.col("first").isNull(), F.col("cap")).otherwise(F.least("cap", F.col("weight") * F.col("first.level")))
    some = some.select("place", "source", "source_size", "weight", slope.alias("slope"), target.alias("target"))
    every = W.orderBy("place").rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    return some.withColumns({"flat": F.sum(F.col("target") * (1 - F.col("slope"))).over(every), "bent": F.sum(F.col("target") * F.col("slope")).over(every)}).drop("place")


def order_key(id_col: str, seed: int):
    """What orders a source's documents: the MD5 of seed and id, as other engines have it too."""
    return F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit(""))).cast("binary"))


def mix_sources(docs: DataFrame, weights: tuple[float, ...] = (5, 2, 1), share: float = 1.5, most: float = 2.0, seed: int = 17, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """One row per row of docs, in training order: id, source, size (words), source_size, target, taken, key, place, positions, shares.

    positions holds the time (0 to 1) at which each pass reaches the document, in order, and shares how much of all the mix's
    words comes before it; both are empty for a document that the mix leaves out. Rows are sorted by their first share within range partitions,
    equal ones by the id's hash, and those that are left out are last. The null source is a source. A null or wordless text has size 0
    and is never taken. Rows that repeat an id stand next to each other, the smaller size first; which of two
    equal ones comes first doesn't change the figures of both together. Reruns agree: only keys decide.
    """
    mixed = _positions(docs, weights, share, most, seed, id_col, text_col, source_col)
    order = (F.get("shares", F.lit(0)).asc_nulls_last(), F.col("key").asc(), F.col("size").asc())
    return mixed.repartitionByRange(*order).sortWithinPartitions(*order)


def _positions(docs: DataFrame, weights: tuple[float, ...], share: float, most: float, seed: int, id_col: str, text_col: str, source_col: str) -> DataFrame:
    """The rows of mix_sources, in no order."""
    text = F.col(text_col).cast("string")
    rows = docs.select(
        F.col(id_col).alias("id"),
        F.col(source_col).cast("string").alias("source"),
        F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long").alias("size"),
        order_key(id_col, seed).alias("key"),
    )
    rows = kept(rows.withColumn("cell", F.substring("key", 1, CELL_DIGITS)))
    cells = kept(rows.groupBy("source", "cell").agg(F.sum("size").alias("words")))
    targets = source_targets(cells.groupBy("source").agg(F.sum("words").alias("source_size")), weights, share, most)
    cells = cells.selectExpr("source", "cell", "coalesce(sum(words) over (partition by source order by cell rows between unbounded preceding and 1 preceding), 0L) as before")
    known = cells.join(targets, cells["source"].eqNullSafe(targets["source"])).select(cells["source"].alias("s"), F.col("cell").alias("k"), "before", "source_size", "target", "slope", "flat", "bent")
    placed = rows.selectExpr("*", "coalesce(sum(size) over (partition by source, cell order by key, size rows between unbounded preceding and 1 preceding), 0L) as within")
    placed = placed.join(known, placed["source"].eqNullSafe(F.col("s")) & (placed["cell"] == F.col("k")))
    start = F.col("before") + F.col("within")
    due = F.floor(F.col("target"))
    passes = F.sequence(F.lit(0), F.lit(int(-(-most // 1)) - 1))
    begins = F.transform(passes, lambda p: p * F.col("source_size") + start)
    part = lambda b: F.greatest(F.lit(0), F.least(F.col("size"), due - b))
    taken = F.aggregate(begins, F.lit(0).cast("long"), lambda a, b: a + part(b))
    # t with (1 - slope) * t + slope * t**2 = share of the target
    x = lambda b: b / F.col("target")
    steep = F.col("slope")
    time = lambda b: F.when(steep == 0, x(b)).otherwise((F.sqrt((1 - steep) * (1 - steep) + 4 * steep * x(b)) - (1 - steep)) / (2 * steep))
    placed = placed.withColumn("begins", F.filter(begins, lambda b: part(b) > 0))
    placed = placed.withColumns({"taken": taken, "place": start, "positions": F.transform("begins", time)})
    shares = F.transform("positions", lambda t: (F.col("flat") * t + F.col("bent") * t * t) / (F.col("flat") + F.col("bent")))
    return placed.select(F.col("id").alias(id_col), F.col("source").alias(source_col), "size", "source_size", "target", "taken", "key", "place", "positions", shares.alias("shares"))


def curriculum(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: int = 17, weights: tuple[float, ...] = (5, 2, 1), share: float = 1.5, most: float = 2.0) -> DataFrame:
    """The documents of the mix in training order, each row once for each pass that takes it, whole.

    A document that a pass takes partly is kept whole, so no text is cut. Sorted by position within range
    partitions, equal positions by the id's hash; columns are those of docs, whatever their names. Null and wordless
    texts are never taken; null ids and the null source are values like others. Of rows that repeat an id each takes its
    share of their positions, shorter texts first. An empty table gives no rows.
    """
    mixed = _positions(docs, weights, share, most, seed, id_col, text_col, source_col)
    times = mixed.where(F.size("positions") > 0).groupBy("key").agg(F.flatten(F.collect_list("positions")).alias("positions"), F.count("*").alias("n"))  # rows of one id
    times = times.select("key", F.posexplode("positions").alias("pass", "at"), "n")
    # a row of docs is one struct, so its names can't clash with those here; the order among rows of one id is no join key, so texts are shuffled by key once
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("doc"), order_key(id_col, seed).alias("key"), F.octet_length(F.col(text_col).cast("string")).alias("length"))
    keyed = rows.select("doc", F.col("key").alias("own"), F.row_number().over(W.partitionBy("key").orderBy("length")).alias("row"))
    out = keyed.join(times, (F.col("own") == F.col("key")) & (F.pmod(F.col("pass"), F.col("n").cast("int")) - F.col("row") == -1))
    return out.repartitionByRange("at").sortWithinPartitions("at", "key").select("doc.*")
