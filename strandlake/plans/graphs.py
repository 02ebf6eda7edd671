"""Graphs of near vectors, their persistence, genomes as vectors and layers of splines on the tables, with the SQL of each."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import genome_vectors as genomes
from ..operators import diagrams, integrity, neighbors, projections, splines, topology
from ..sources import table

QUERIES, SQL = {}, {}


def query(sql: str | None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def _graph(name: str, vector: str) -> str:
    return f"""{name} AS (SELECT id, rank, near, score FROM (SELECT x.vec_id AS id, y.vec_id AS near, round(list_inner_product(x.v, y.v) / sqrt(list_inner_product(x.v, x.v)) / sqrt(list_inner_product(y.v, y.v)), 9) AS score,
  row_number() OVER (PARTITION BY x.vec_id ORDER BY round(list_inner_product(x.v, y.v) / sqrt(list_inner_product(x.v, x.v)) / sqrt(list_inner_product(y.v, y.v)), 9) DESC, y.vec_id)::INT AS rank
  FROM (SELECT vec_id, {vector}::DOUBLE[] AS v FROM embeddings) x JOIN (SELECT vec_id, {vector}::DOUBLE[] AS v FROM embeddings) y ON x.vec_id <> y.vec_id) WHERE rank <= 10)"""


def vectors(spark, sf, first: int | None = None):
    v = F.col("embedding") if first is None else F.slice("embedding", 1, first)
    return table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), v.alias("vector"))


@query(f"WITH {_graph('g', 'embedding')} SELECT id AS vec_id, rank, near, round(score, 5) AS score FROM g")
def knn_graph(spark, sf):
    return neighbors.knn_graph(vectors(spark, sf), k=10).select(F.col("id").alias("vec_id"), "rank", "near", F.round("score", 5).alias("score"))


@query(f"""WITH {_graph('g', 'embedding')}, {_graph('h', 'embedding[1:32]')}, c AS (SELECT g.id, count(h.near) AS common FROM g LEFT JOIN h ON g.id = h.id AND g.near = h.near GROUP BY g.id)
SELECT id AS vec_id, common, round(common / (20 - common), 6) AS jaccard FROM c""")
def neighborhood_preservation(spark, sf):
    """How many of each row's ten nearest stay its nearest when only half of the components are kept."""
    kept = neighbors.preserved(neighbors.knn_graph(vectors(spark, sf)), neighbors.knn_graph(vectors(spark, sf, 32)))
    return kept.select(F.col("id").alias("vec_id"), "common", F.round("jaccard", 6).alias("jaccard"))


def near_edges(spark, sf):
    """The graph's edges, both ways as one, by cosine distance."""
    graph = neighbors.knn_graph(vectors(spark, sf), k=10)
    return graph.select(F.least("id", "near").alias("a"), F.greatest("id", "near").alias("b"), F.round(1 - F.col("score"), 6).alias("w")).distinct()


#: Prim's walk, one vertex a step; where no edge leads out, a new component begins at the smallest vertex left.
PRIM = f"""{_graph('g', 'embedding')}, e AS (SELECT DISTINCT least(id, near) AS a, greatest(id, near) AS b, round(1 - score, 6) AS w FROM g), v AS (SELECT DISTINCT id AS v FROM g), prim AS (
  SELECT [(SELECT min(v) FROM v)] AS seen, NULL::STRUCT(w DOUBLE, a BIGINT, b BIGINT) AS x, (SELECT min(v) FROM v) AS y
  UNION ALL
  SELECT list_append(seen, coalesce(CASE WHEN list_contains(seen, n.a) THEN n.b ELSE n.a END, m)), n, CASE WHEN n IS NULL THEN m END FROM (
    SELECT seen, (SELECT min({{'w': w, 'a': a, 'b': b}}) FROM e WHERE list_contains(seen, a) <> list_contains(seen, b)) AS n, (SELECT min(v) FROM v WHERE NOT list_contains(seen, v)) AS m
    FROM prim WHERE len(seen) < (SELECT count(*) FROM v)))"""


@query(f"WITH RECURSIVE {PRIM} SELECT coalesce(x.a, y) AS a, coalesce(x.b, y) AS b, x.w AS death FROM prim")
def h0_persistence(spark, sf):
    """When the components of the graph of near vectors merge, over all rows."""
    return topology.h0_persistence(near_edges(spark, sf))


#: The walk within each label, whose diagrams have births at 0 only: then points are matched in order of death, or go to the diagonal both.
WITHIN = PRIM.replace("FROM g), v AS", "FROM g JOIN embeddings p ON p.vec_id = g.id JOIN embeddings q ON q.vec_id = g.near AND p.label = q.label), v AS")


@query(f"""WITH RECURSIVE {WITHIN}, d AS (SELECT label, x.w AS death FROM prim JOIN embeddings ON vec_id = x.a WHERE x IS NOT NULL), r AS (SELECT label, death, row_number() OVER (PARTITION BY label ORDER BY death DESC) AS i FROM d),
k AS (SELECT DISTINCT label FROM embeddings), m AS (SELECT a.label AS a, b.label AS b, i FROM k a JOIN k b ON a.label < b.label, range(1, 501) t(i))
SELECT m.a, m.b, round(max(least(abs(coalesce(p.death, 0) - coalesce(q.death, 0)), greatest(coalesce(p.death, 0), coalesce(q.death, 0)) / 2)), 6) AS distance
FROM m LEFT JOIN r p ON p.label = m.a AND p.i = m.i LEFT JOIN r q ON q.label = m.b AND q.i = m.i GROUP BY m.a, m.b""")
def label_diagram_distances(spark, sf):
    """How far the labels' diagrams are apart, each of the near edges between its own rows; what never dies is left out, as their numbers differ."""
    of = table(spark, sf, "embeddings").select("vec_id", "label")
    edges = near_edges(spark, sf).join(of.select(F.col("vec_id").alias("a"), F.col("label").alias("la")), "a").join(of.select(F.col("vec_id").alias("b"), F.col("label").alias("lb")), "b").where("la = lb")
    pairs = topology.h0_persistence(edges.select("a", "b", "w"), of.select(F.col("vec_id").alias("v"))).join(of, F.col("a") == F.col("vec_id"))
    names = of.select(F.col("label").alias("a")).distinct()
    both = names.join(names.withColumnRenamed("a", "b"), F.col("a") < F.col("b"))  # of ten labels
    return diagrams.bottleneck_distances(pairs.where("death is not null").select(F.col("label").alias("diagram"), F.lit(0.0).alias("birth"), "death"), both).select("a", "b", F.round("distance", 6).alias("distance"))


@query(None)
def genome_encode(spark, sf):
    """A vector for each supplier, of its lines as variants."""
    letter = lambda c: F.element_at(F.array(*map(F.lit, genomes.BASES)), (F.col(c) % 4 + 1).cast("int"))
    kinds = F.when(F.col("l_returnflag") == "A", "INS").when(F.col("l_returnflag") == "R", "DEL").otherwise("SNP")
    lines = table(spark, sf, "lineitem").select(
        F.col("l_suppkey").alias("sample"), F.concat(F.lit("chr"), "l_linenumber").alias("chrom"), (F.col("l_partkey") * 1000).alias("pos"), letter("l_partkey").alias("ref"), letter("l_orderkey").alias("alt"), kinds.alias("kind")
    )
    return genomes.genome_vectors(lines, dimension=256).select("sample", "n", F.transform("vector", lambda x: F.round(x, 6)).alias("vector"))


@query(None)
def sequence_encode(spark, sf):
    """A vector for each document, of the bases among its letters."""
    texts = table(spark, sf, "documents").select(F.col("doc_id").alias("id"), "text")
    return genomes.sequence_vectors(texts, dimension=64).select(F.col("id").alias("doc_id"), F.transform("vector", lambda x: F.round(x, 6)).alias("vector"))


def coefficients(spark, outputs: int, inputs: int):
    """Made by a rule, as the tables have none: 12 knots' functions of each pair of input and output."""
    cells = spark.range(outputs * inputs * 12).select((F.col("id") % outputs).cast("int").alias("output"), F.expr(f"cast(id div {outputs} % {inputs} as int)").alias("input"), F.expr(f"cast(id div {outputs * inputs} as int)").alias("k"))
    return cells.select("*", (((F.col("output") * 31 + F.col("input") * 17 + F.col("k") * 7) % 101) / 101.0 - 0.5).alias("c"))


def _layer(name: str, source: str, outputs: int) -> str:
    """Over even knots a cubic's four pieces, by where x lies in its interval."""
    return f"""{name}_x AS (SELECT id, i, (least(greatest(x, -1), 1) + 1) * 4.5 AS p, least(floor((least(greatest(x, -1), 1) + 1) * 4.5), 8)::INT AS m FROM {source}), {name}_b AS (
  SELECT id, i, m + r AS k, CASE r WHEN 0 THEN pow(1 - u, 3) / 6 WHEN 1 THEN (3 * u * u * u - 6 * u * u + 4) / 6 WHEN 2 THEN (-3 * u * u * u + 3 * u * u + 3 * u + 1) / 6 ELSE u * u * u / 6 END AS w FROM (SELECT *, p - m AS u, unnest(range(4)) AS r FROM {name}_x)
), {name} AS (SELECT id, o AS i, tanh(sum(w * (((o * 31 + i * 17 + k * 7) % 101) / 101.0::DOUBLE - 0.5::DOUBLE))) AS x FROM {name}_b, range({outputs}) t(o) GROUP BY id, o)"""


@query(f"WITH s AS (SELECT vec_id AS id, (pos - 1)::INT AS i, embedding[pos]::DOUBLE AS x FROM (SELECT vec_id, embedding, unnest(range(1, 65)) AS pos FROM embeddings)), {_layer('a', 's', 8)}, {_layer('b', 'a', 3)} SELECT id AS vec_id, i::INT AS pos, round(x, 5) AS x FROM b")
def spline_encode(spark, sf):
    """Two layers of cubic splines, from 64 components to 8 to 3."""
    out = splines.spline_encode(vectors(spark, sf), [coefficients(spark, 8, 64), coefficients(spark, 3, 8)])
    return out.select(F.col("id").alias("vec_id"), F.posexplode("vector").alias("pos", "x")).withColumn("x", F.round("x", 5))


@query(None)
def projections_by_kind(spark, sf):
    """Each vector through a sparse, a gaussian and an orthogonal projection to 16 components."""
    out = None
    for kind in projections.KINDS:
        one = projections.project(vectors(spark, sf), 16, 64, kind, seed=3)
        one = one.select(F.col("id").alias("vec_id"), F.lit(kind).alias("kind"), F.transform("vector", lambda x: F.round(x, 6)).alias("vector"))
        out = one if out is None else out.unionByName(one)
    return out


#: A level a step, as lists of hashes: each pair is hashed after its lengths, an odd last one with itself.
TREE = """l AS (SELECT p_partkey - (SELECT min(p_partkey) FROM part) AS i, sha256(p_partkey || ':' || p_name) AS h FROM part), tree AS (
  SELECT list(h ORDER BY i) AS h FROM l UNION ALL
  SELECT list_transform(range(1, len(h) + 1, 2), lambda j: sha256(unhex('00000004') || encode('NODE') || unhex('00000020') || unhex(h[j]) || unhex('00000020') || unhex(coalesce(h[j + 1], h[j])))) FROM tree WHERE len(h) > 1)"""


@query(f"""WITH RECURSIVE {TREE}, k AS (SELECT i, CASE WHEN i % 97 = 5 THEN sha256(h || 'x') ELSE h END AS h FROM l), up AS (
  SELECT i, h, i AS pos, (SELECT list(h ORDER BY i) FROM l) AS t FROM k UNION ALL
  SELECT i, sha256(unhex('00000004') || encode('NODE') || unhex('00000020') || unhex(CASE WHEN pos % 2 = 0 THEN h ELSE t[pos] END) || unhex('00000020') || unhex(CASE WHEN pos % 2 = 1 OR pos + 1 = len(t) THEN h ELSE t[pos + 2] END)), pos // 2,
    (SELECT any_value(h) FROM tree WHERE len(h) = (len(t) + 1) // 2) FROM up WHERE len(t) > 1
) SELECT i AS idx, h = t[1] AS valid FROM up WHERE len(t) = 1""")
def merkle_verified(spark, sf):
    """Each part's claim against the tree of all; every 97th has been tampered with."""
    part = table(spark, sf, "part")
    low = part.agg(F.min("p_partkey").alias("low"))  # one row
    leaves = part.join(F.broadcast(low)).select((F.col("p_partkey") - F.col("low")).alias("idx"), F.sha2(F.concat_ws(":", "p_partkey", "p_name"), 256).alias("hash"))
    claims = leaves.select("idx", F.when(F.col("idx") % 97 == 5, F.sha2(F.concat("hash", F.lit("x")), 256)).otherwise(F.col("hash")).alias("hash"))
    return integrity.merkle_verified(leaves, claims)
