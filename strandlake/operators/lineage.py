"""Lineage of nodes with one parent each: ancestors, roots and paths by pointer doubling, so in as many joins as the depth has binary digits."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .steps import Steps


def lineage(edges: DataFrame, paths: bool = False) -> DataFrame:
    """edges (child, parent) to one row for each child: node, root, ancestors, cyclic, and with paths its path (an array from the root down to it).

    A child of several parents has the smallest; a null child or parent is no edge. Nodes on a ring, or below one, are cyclic:
    they have no root, no count and no path. Each round doubles how far every node has looked up; nodes that have met their
    root move no more, and only say where they ended. A node with very many children is one row of the side that is looked up, so the join that meets it
    can be split. A path holds a node's ancestors in one row.
    """
    steps = Steps(edges.sparkSession)
    known = edges.where("child is not null and parent is not null").groupBy(F.col("child").alias("node")).agg(F.min("parent").alias("at"))
    # path: the nodes below at, down to node
    live = steps.written(known.select("node", "at", F.lit(1).cast("long").alias("n"), F.array("node").alias("path")), "live")
    columns = ["node", "at", "n", *(["path"] if paths else [])]
    total, looked, done = live.count(), 1, live.select(*columns).limit(0)
    while not live.isEmpty() and looked <= 2 * total:  # no way up is longer than all nodes
        ahead = live.select(*columns).unionByName(done)
        ahead = ahead.select(F.col("node").alias("at"), F.col("at").alias("next"), F.col("n").alias("more"), *([F.col("path").alias("above")] if paths else []))
        met = steps.written(live.select(*columns).join(ahead, "at", "left"), "met")
        done = done.unionByName(met.where("next is null").select(*columns))
        further = met.where("next is not null").select("node", F.col("next").alias("at"), (F.col("n") + F.col("more")).alias("n"), *([F.concat("above", "path").alias("path")] if paths else []))
        live, looked = steps.written(further, "live"), 2 * looked
    out = done.select("node", F.col("at").alias("root"), F.col("n").alias("ancestors"), F.lit(False).alias("cyclic"), *([F.concat(F.array("at"), "path").alias("path")] if paths else []))
    none = [F.lit(None).cast(out.schema[c].dataType).alias(c) for c in ("root", "ancestors")]
    return out.unionByName(live.select("node", *none, F.lit(True).alias("cyclic"), *([F.lit(None).cast(out.schema["path"].dataType).alias("path")] if paths else [])))
