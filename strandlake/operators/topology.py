"""Persistence of components of weighted graphs, as rounds of joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .steps import Steps


def _roots(pointers: DataFrame, steps: Steps) -> DataFrame:
    """(c, root) of pointers (c, o): where each ends, by doubling. A root points to itself."""
    while True:
        ends = pointers.select(F.col("c").alias("o"), F.col("o").alias("next"))
        further = steps.written(pointers.join(ends, "o", "left").select("c", F.coalesce("next", "o").alias("o"), (F.coalesce("next", "o") != F.col("o")).alias("moved")), "pointers")
        if further.where("moved").isEmpty():
            return further.select("c", F.col("o").alias("root"))
        pointers = further.select("c", "o")


def h0_persistence(edges: DataFrame, vertices: DataFrame | None = None) -> DataFrame:
    """edges (a, b, w) to (a, b, death): the edges at which components merge as w grows, and each last component with a null death.

    All components are born at 0, so a pair dies at the weight of its edge in the least spanning forest; what never dies has a = b,
    its smallest vertex. Boruvka's rounds: the lightest edge of each component, by (w, a, b), is taken, components contract to
    where those edges lead, and of parallel edges the lightest stays; each round halves the components at least. Loops
    and edges with a null or NaN weight are left out. vertices (v) adds vertices that no edge has.
    """
    steps = Steps(edges.sparkSession)
    edges = steps.written(edges.select("a", "b", "w"), "edges")  # read twice, and a neighbour graph behind them is a search of all rows
    known = edges.where("a <> b and w is not null and not isnan(w)").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), F.col("w").cast("double").alias("w"))
    light = F.min(F.struct("w", "a", "b")).alias("e")
    live = steps.written(known.groupBy(F.col("a").alias("x"), F.col("b").alias("y")).agg(light), "live")
    nodes = edges.select(F.explode(F.array("a", "b")).alias("v")) if vertices is None else edges.select(F.explode(F.array("a", "b")).alias("v")).unionByName(vertices.select("v"))
    parts = steps.written(nodes.where("v is not null").distinct().select(F.col("v").alias("c"), F.col("v").alias("least")), "parts")
    taken = None
    while not live.isEmpty():
        ways = live.select(F.explode(F.array(F.struct(F.col("x").alias("c"), F.col("y").alias("o")), F.struct(F.col("y").alias("c"), F.col("x").alias("o")))).alias("way"), "e")
        lightest = ways.groupBy("way.c").agg(F.min(F.struct("e.w", "e.a", "e.b", F.col("way.o").alias("o"))).alias("e"))
        lightest = steps.written(lightest.select("c", "e.*"), "lightest")
        new = lightest.select("a", "b", F.col("w").alias("death")).distinct()
        taken = new if taken is None else taken.unionByName(new)
        # of two components that take the same edge the smaller is a root; edges are in a strict order, so there are no other rings
        back = lightest.select(F.col("c").alias("o"), F.col("o").alias("back"))
        pointers = lightest.select("c", "o").join(back, "o").select("c", F.when((F.col("back") == F.col("c")) & (F.col("c") < F.col("o")), F.col("c")).otherwise(F.col("o")).alias("o"))
        roots = _roots(steps.written(pointers, "pointers"), steps)
        to = lambda c: roots.select(F.col("c").alias(c), F.col("root").alias(f"root_{c}"))
        moved = live.join(to("x"), "x").join(to("y"), "y").where("root_x <> root_y")
        parts = steps.written(parts.join(roots, "c", "left").groupBy(F.coalesce("root", "c").alias("c")).agg(F.min("least").alias("least")), "parts")
        live = steps.written(moved.groupBy(F.least("root_x", "root_y").alias("x"), F.greatest("root_x", "root_y").alias("y")).agg(F.min("e").alias("e")), "live")
    last = parts.select(F.col("least").alias("a"), F.col("least").alias("b"), F.lit(None).cast("double").alias("death"))
    return last if taken is None else taken.unionByName(last)
