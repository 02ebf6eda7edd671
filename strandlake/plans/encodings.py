"""Vector encodings, similarity, private retrieval, graphs of near vectors and lineage on the tables, with the SQL of each."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import encoders as E
from ..functions import vectors as V
from ..operators import blocks, lineage, pir, sequences
from ..operators.steps import Steps
from ..sources import table

QUERIES, SQL = {}, {}


def query(sql: str | None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


#: Each vector beside the one before it of its label.
PAIRS = "p AS (SELECT vec_id, embedding::DOUBLE[] AS a, lag(embedding) OVER (PARTITION BY label ORDER BY vec_id)::DOUBLE[] AS b FROM embeddings), q AS (SELECT * FROM p WHERE b IS NOT NULL)"


def pairs(spark, sf):
    rows = table(spark, sf, "embeddings").select("vec_id", "label", F.col("embedding").alias("a"))
    return sequences.beside_previous(rows, "label", "vec_id", "a", "b").where("b is not null").select("vec_id", "a", "b")


def cells(rows, value, digits=6):
    """(vec_id, pos, x) of array columns."""
    return rows.select("vec_id", F.posexplode(value).alias("pos", "x")).withColumn("x", F.round("x", digits) if digits else F.col("x"))


EACH = "SELECT vec_id, (i - 1)::INT AS pos, {x} AS x FROM (SELECT vec_id, a, b, unnest(range(1, 65)) AS i FROM q)"


@query(f"WITH {PAIRS} " + EACH.format(x="round(a[i] * b[i], 6)"))
def bind_multiply(spark, sf):
    return cells(pairs(spark, sf), V.bound(F.col("a"), F.col("b")))


@query(f"WITH {PAIRS} " + EACH.format(x="CASE WHEN (a[i] > 0) <> (b[i] > 0) THEN 1 ELSE -1 END"))
def bind_xor(spark, sf):
    return cells(pairs(spark, sf), E.bound_xor(F.col("a"), F.col("b")), None)


@query(f"WITH {PAIRS} " + EACH.format(x="round(a[i] * b[i] / (b[i] + 1e-8), 4)"))
def protect_roundtrip(spark, sf):
    return cells(pairs(spark, sf), E.unbound(V.bound(F.col("a"), F.col("b")), F.col("b")), 4)


@query(f"WITH {PAIRS} SELECT vec_id, (i - 1)::INT AS pos, round(list_sum(list_transform(range(0, 64), lambda j: a[j + 1] * b[(i - 1 - j + 64) % 64 + 1])), 9) AS x FROM (SELECT vec_id, a, b, unnest(range(1, 65)) AS i FROM q)")
def bind_circular_fft(spark, sf):
    return cells(pairs(spark, sf), E.circular_fft("a", "b"), 9)


@query(f"WITH {PAIRS} " + EACH.format(x="round(0.7 * a[i] * b[i] + 0.3 * b[i], 6)"))
def role_filler(spark, sf):
    """A bundle of two weighted bindings."""
    one, other = E.weighted(V.bound(F.col("a"), F.col("b")), F.lit(0.7)), E.weighted(F.col("b"), F.lit(0.3))
    return cells(pairs(spark, sf), F.zip_with(one, other, lambda x, y: x + y))


@query("SELECT n_nationkey, i::INT AS pos, round(CASE WHEN i % 2 = 0 THEN sin(n_nationkey / pow(10000, i / 16.0)) ELSE cos(n_nationkey / pow(10000, (i - 1) / 16.0)) END, 6) AS x FROM (SELECT n_nationkey, unnest(range(16)) AS i FROM nation)")
def position_encoding(spark, sf):
    return table(spark, sf, "nation").select("n_nationkey", F.posexplode(E.position_vector(F.col("n_nationkey"), 16)).alias("pos", "x")).withColumn("x", F.round("x", 6))


SIGN = "(CASE WHEN strpos('01234567', substr(md5(concat('7:', r, ':', pos)), 1, 1)) > 0 THEN 1 ELSE -1 END)"
PROJECTED = f"c AS (SELECT vec_id, unnest(range(64)) AS pos, unnest(embedding)::DOUBLE AS x FROM embeddings), m AS (SELECT pos, r, {SIGN} AS s FROM (SELECT unnest(range(64)) AS pos), (SELECT unnest(range(16)) AS r)), v AS (SELECT vec_id, r, sum(x * s) / 4 AS value FROM c JOIN m USING (pos) GROUP BY vec_id, r)"


@query(f'WITH {PROJECTED} SELECT vec_id, r::INT AS "row", round(value, 5) AS value FROM v')
def random_projection(spark, sf):
    return E.projected(table(spark, sf, "embeddings"), "vec_id", "embedding", 16).withColumn("value", F.round("value", 5))


@query(f'WITH {PROJECTED} SELECT vec_id, r::INT AS "row", CASE WHEN value >= 0 THEN 1 ELSE -1 END AS sign FROM v')
def project_sign(spark, sf):
    return E.projected(table(spark, sf, "embeddings"), "vec_id", "embedding", 16).select("vec_id", "row", F.when(F.col("value") >= 0, 1).otherwise(-1).alias("sign"))


@query(f"WITH {PROJECTED} SELECT vec_id, sum(CASE WHEN value >= 0 THEN 1::BIGINT << r::INT ELSE 0 END)::BIGINT AS bits FROM v GROUP BY vec_id")
def simhash_bits(spark, sf):
    found = E.projected(table(spark, sf, "embeddings"), "vec_id", "embedding", 16)
    return found.groupBy("vec_id").agg(F.sum(F.when(F.col("value") >= 0, F.pow(F.lit(2.0), F.col("row")).cast("long")).otherwise(0)).alias("bits"))


@query("SELECT vec_id, (i - 1)::INT AS pos, round_even((e[i] - lo) / greatest(hi - lo, 1e-12) * 15, 0)::INT AS x FROM (SELECT vec_id, embedding::DOUBLE[] AS e, list_min(embedding)::DOUBLE AS lo, list_max(embedding)::DOUBLE AS hi, unnest(range(1, 65)) AS i FROM embeddings)")
def quantize_levels(spark, sf):
    return cells(table(spark, sf, "embeddings"), E.quantized(F.col("embedding"), 16), None)


@query("SELECT vec_id, ((i - 1) // 3)::INT AS pos, round(e[i], 6) AS x FROM (SELECT vec_id, embedding::DOUBLE[] AS e, unnest(range(1, 65, 3)) AS i FROM embeddings)")
def tier_vector(spark, sf):
    return cells(table(spark, sf, "embeddings"), F.transform(E.every_nth(F.col("embedding"), 3), lambda x: x.cast("double")))


COSINE = "list_cosine_similarity({a}, {b})"


@query(f"WITH {PAIRS} SELECT vec_id, round({COSINE.format(a='a', b='b')}, 5) AS cosine, round((1 + {COSINE.format(a='a', b='b')}) / 2, 5) AS unit FROM q")
def cosine_pairs(spark, sf):
    c = V.cosine(F.col("a"), F.col("b"))
    return pairs(spark, sf).select("vec_id", F.round(c, 5).alias("cosine"), F.round((1 + c) / 2, 5).alias("unit"))


@query(f"WITH {PAIRS} SELECT vec_id, round(0.33 * {COSINE.format(a='a[1:16]', b='b[1:16]')} + 0.33 * {COSINE.format(a='a[1:32]', b='b[1:32]')} + 0.34 * {COSINE.format(a='a', b='b')}, 5) AS similarity FROM q")
def multires_sim(spark, sf):
    part = lambda n: V.cosine(F.slice("a", 1, n), F.slice("b", 1, n))
    return pairs(spark, sf).select("vec_id", F.round(0.33 * part(16) + 0.33 * part(32) + 0.34 * part(64), 5).alias("similarity"))


@query(f"WITH {PAIRS} SELECT vec_id, round(1 - list_sum(list_transform(range(1, 65), lambda i: ((a[i] > 0) <> (b[i] > 0))::INT)) / 64, 6) AS hamming, round(1 - least(list_distance(a, b) / 16, 1), 6) AS euclid FROM q")
def sim_metrics(spark, sf):
    a, b = F.col("a"), F.col("b")
    return pairs(spark, sf).select("vec_id", F.round(1 - V.hamming(a, b) / F.size(a), 6).alias("hamming"), F.round(1 - F.least(V.euclidean(a, b) / (2 * F.sqrt(F.size(a))), F.lit(1.0)), 6).alias("euclid"))


@query(f"WITH {PAIRS} SELECT vec_id, round(list_sum(list_transform(range(1, 65), lambda i: least(abs(a[i]), abs(b[i])))) / list_sum(list_transform(range(1, 65), lambda i: greatest(abs(a[i]), abs(b[i])))), 5) AS similarity FROM q")
def jaccard_minmax(spark, sf):
    return pairs(spark, sf).select("vec_id", F.round(E.jaccard_minmax(F.col("a"), F.col("b")), 5).alias("similarity"))


@query(f"WITH {PAIRS} SELECT vec_id, round(list_sum(list_transform(range(1, 65), lambda i: (a[i] > 0 AND b[i] > 0)::INT)) / list_sum(list_transform(range(1, 65), lambda i: (a[i] > 0 OR b[i] > 0)::INT)), 6) AS similarity FROM q")
def jaccard_bool(spark, sf):
    return pairs(spark, sf).select("vec_id", F.round(E.jaccard_bool(F.col("a"), F.col("b")), 6).alias("similarity"))


@query(f"WITH {PAIRS} SELECT vec_id, round(1 - list_sum(list_transform(range(1, 65), lambda i: abs(a[i] - b[i]))) / 64, 5) AS similarity FROM q")
def mae_sim(spark, sf):
    return pairs(spark, sf).select("vec_id", F.round(1 - E.mean_absolute(F.col("a"), F.col("b")), 5).alias("similarity"))


@query(f"WITH {PAIRS}, u AS (SELECT vec_id, unnest(a) AS x, unnest(b) AS y FROM q) SELECT vec_id, round(corr(x, y), 5) AS r FROM u GROUP BY vec_id")
def pearson_pairs(spark, sf):
    both = pairs(spark, sf).select("vec_id", F.explode(F.arrays_zip("a", "b")).alias("z"))
    return both.groupBy("vec_id").agg(F.round(F.corr(F.col("z.a").cast("double"), F.col("z.b").cast("double")), 5).alias("r"))


@query(f"""WITH {PAIRS}, u AS (SELECT vec_id, unnest(a) AS x, unnest(b) AS y FROM q), r AS (SELECT vec_id, x, y, rank() OVER (PARTITION BY vec_id ORDER BY x) + (count(*) OVER (PARTITION BY vec_id, x) - 1) / 2.0 AS rx, rank() OVER (PARTITION BY vec_id ORDER BY y) + (count(*) OVER (PARTITION BY vec_id, y) - 1) / 2.0 AS ry FROM u)
SELECT vec_id, round(corr(rx, ry), 5) AS spearman, round(avg(((x > 0) = (y > 0))::INT), 6) AS haplotype, round(sum(least(abs(x), abs(y))) / least(sum(abs(x)), sum(abs(y))), 5) AS structural FROM r GROUP BY vec_id""")
def biological_pairs(spark, sf):
    """Rank correlation, the share of equal alleles (a component's sign) and the overlap of each vector with the one before it of its label."""
    a, b = F.col("a"), F.col("b")
    alleles = lambda v: F.transform(v, lambda x: x > 0)
    return pairs(spark, sf).select("vec_id", F.round(E.spearman(a, b), 5).alias("spearman"), F.round(E.haplotype(alleles(a), alleles(b)), 6).alias("haplotype"), F.round(E.structural(a, b), 5).alias("structural"))


KNN = "s AS (SELECT x.vec_id AS query_id, y.vec_id AS vec_id, list_inner_product(x.embedding::DOUBLE[], y.embedding::DOUBLE[]) AS score FROM embeddings x JOIN embeddings y ON x.vec_id <> y.vec_id WHERE x.vec_id % 50 = 0)"


def _asked(spark, sf):
    """Every row, and the stated queries: those of ids divisible by 50."""
    rows = table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("v"))
    return rows.where("id % 50 = 0"), rows


@query(f"WITH {KNN}, r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, vec_id) AS rank FROM s) SELECT query_id, vec_id, rank::INT AS rank, round(score, 5) AS score FROM r WHERE rank <= 10")
def knn_score(spark, sf):
    return blocks.nearest_of(*_asked(spark, sf), 10).select("query_id", "vec_id", "rank", F.round("score", 5).alias("score"))


@query(f"""WITH {KNN}, r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, vec_id) AS rank FROM s), n AS (SELECT query_id, vec_id FROM r WHERE rank <= 10)
SELECT a.query_id AS a, b.query_id AS b, count(*) AS common, round(count(*) / (20 - count(*)), 6) AS jaccard FROM n a JOIN n b ON a.vec_id = b.vec_id AND a.query_id < b.query_id GROUP BY ALL""")
def neighbor_jaccard(spark, sf):
    near = Steps(spark).written(knn_score(spark, sf).select("query_id", "vec_id"), "near")  # read by both sides
    a, b = near.withColumnRenamed("query_id", "a"), near.withColumnRenamed("query_id", "b")
    n = F.count("*")
    return a.join(b, "vec_id").where("a < b").groupBy("a", "b").agg(n.alias("common"), F.round(n / (20 - n), 6).alias("jaccard"))


ALL_EDGES = "e AS (SELECT x.vec_id AS a, y.vec_id AS b, list_distance(x.embedding::DOUBLE[], y.embedding::DOUBLE[]) AS d FROM embeddings x JOIN embeddings y ON x.label = y.label AND x.vec_id < y.vec_id)"
#: Those of three labels.
EDGES = ALL_EDGES[:-1] + " WHERE x.label < 3)"


def _labelled(spark, sf):
    return table(spark, sf, "embeddings").select("label", F.col("vec_id").alias("id"), F.col("embedding").alias("v"))


@query(f"WITH {EDGES} SELECT a, b, round(d, 5) AS d FROM e WHERE d <= 1.35")
def vr_edges(spark, sf):
    return blocks.close_pairs(_labelled(spark, sf).where("label < 3"), 1.35).select("a", "b", F.round("d", 5).alias("d"))


@query(f"WITH {ALL_EDGES}, n AS (SELECT * FROM e WHERE d <= 1.35) SELECT x.a, x.b, y.b AS c, round(greatest(x.d, y.d, z.d), 5) AS scale FROM n x JOIN n y ON x.b = y.a JOIN n z ON z.a = x.a AND z.b = y.b")
def vr_triangles(spark, sf):
    return blocks.triangles(_labelled(spark, sf), 1.35, digits=5)


@query(f"WITH {EDGES} SELECT count(*) FILTER (d - 0.3 >= 1) AS persistent FROM e")
def persistence_filter(spark, sf):
    return blocks.far_pairs(_labelled(spark, sf).where("label < 3"), 0.3, 1.0).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("persistent"))


@query("SELECT vec_id, pos::INT AS pos, round(x, 6) AS x, rank::INT AS rank FROM (SELECT vec_id, pos, x, row_number() OVER (PARTITION BY vec_id ORDER BY abs(x) DESC, pos) AS rank FROM (SELECT vec_id, unnest(range(64)) AS pos, unnest(embedding)::DOUBLE AS x FROM embeddings)) WHERE rank <= 5")
def top_features(spark, sf):
    each = table(spark, sf, "embeddings").select("vec_id", F.posexplode("embedding").alias("pos", "x")).withColumn("x", F.col("x").cast("double"))
    return each.withColumn("rank", F.row_number().over(W.partitionBy("vec_id").orderBy(F.desc(F.abs("x")), "pos"))).where("rank <= 5").withColumn("x", F.round("x", 6))


@query("SELECT vec_id, (trunc(abs(x * 1000))::BIGINT % 32)::INT AS slot, sum(sign(x))::INT AS value FROM (SELECT vec_id, unnest(embedding)::DOUBLE AS x FROM embeddings) GROUP BY ALL")
def feature_hashing(spark, sf):
    each = table(spark, sf, "embeddings").select("vec_id", F.explode("embedding").alias("x")).withColumn("x", F.col("x").cast("double"))
    return each.groupBy("vec_id", (F.abs(F.col("x") * 1000).cast("long") % 32).cast("int").alias("slot")).agg(F.sum(F.signum("x")).cast("int").alias("value"))


@query("SELECT label, bool_and(d >= 0) AS rising, bool_and(d <= 0) AS falling, count(*) FILTER (d > 0) AS rises, count(*) AS n FROM (SELECT label, embedding[1] - lag(embedding[1]) OVER (PARTITION BY label ORDER BY vec_id) AS d FROM embeddings) WHERE d IS NOT NULL GROUP BY label")
def monotone_series(spark, sf):
    """Whether each label's first component rises or falls throughout, by id."""
    rows = table(spark, sf, "embeddings").select("vec_id", "label", F.get("embedding", F.lit(0)).alias("x"))
    steps = sequences.beside_previous(rows, "label", "vec_id", "x", "p").select("label", (F.col("x") - F.col("p")).alias("d")).where("d is not null")
    return steps.groupBy("label").agg(F.bool_and(F.col("d") >= 0).alias("rising"), F.bool_and(F.col("d") <= 0).alias("falling"), F.count_if(F.col("d") > 0).alias("rises"), F.count("*").alias("n"))


@query("SELECT label, count(*) AS n, count(*) FILTER (d > 0.9) AS flagged, round(avg(d), 5) AS mean, round(max(d), 5) AS top FROM (SELECT label, 1 - list_cosine_similarity(embedding::DOUBLE[], lag(embedding) OVER (PARTITION BY label ORDER BY vec_id)::DOUBLE[]) AS d FROM embeddings) WHERE d IS NOT NULL GROUP BY label")
def drift_summary(spark, sf):
    rows = sequences.beside_previous(table(spark, sf, "embeddings").select("vec_id", "label", "embedding"), "label", "vec_id", "embedding", "p").where("p is not null").select("label", (1 - V.cosine(F.col("embedding"), F.col("p"))).alias("d"))
    return rows.groupBy("label").agg(F.count("*").alias("n"), F.count_if(F.col("d") > 0.9).alias("flagged"), F.round(F.avg("d"), 5).alias("mean"), F.round(F.max("d"), 5).alias("top"))


@query("SELECT word, count(*) AS n FROM (SELECT unnest(regexp_extract_all(lower(text), '[a-z]+')) AS word FROM documents) GROUP BY word HAVING count(*) >= 100")
def encode_tokens(spark, sf):
    """How often each token counts in the bundle of all."""
    return table(spark, sf, "documents").select(F.explode(F.regexp_extract_all(F.lower("text"), F.lit("([a-z]+)"), F.lit(1))).alias("word")).groupBy("word").agg(F.count("*").alias("n")).where("n >= 100")


@query("SELECT greatest(0, least(255, floor((value - m) / d * 32 + 128)))::INT AS bucket, count(*) AS n FROM events, (SELECT avg(value) AS m, stddev_pop(value) AS d FROM events) GROUP BY 1")
def histogram_buckets(spark, sf):
    events = table(spark, sf, "events")
    stats = events.agg(F.avg("value").alias("m"), F.stddev_pop("value").alias("d"))  # one row
    at = F.greatest(F.lit(0), F.least(F.lit(255), F.floor((F.col("value") - F.col("m")) / F.col("d") * 32 + 128))).cast("int")
    return events.join(F.broadcast(stats)).groupBy(at.alias("bucket")).agg(F.count("*").alias("n"))


@query("SELECT o_custkey AS payload FROM orders WHERE o_orderkey = 42")
def pir_retrieve(spark, sf):
    return pir.retrieved(table(spark, sf, "orders").select(F.col("o_orderkey").alias("idx"), F.col("o_custkey").cast("long").alias("payload")), 42)


@query("SELECT (sum(o_custkey) FILTER (o_orderkey % 5 = 2) % 256)::BIGINT AS answer FROM orders")
def pir_sum256(spark, sf):
    return table(spark, sf, "orders").where("o_orderkey % 5 = 2").agg((F.sum("o_custkey") % 256).alias("answer"))


@query("SELECT o_custkey % 4 AS shard, bit_xor(o_orderkey) AS answer FROM orders GROUP BY ROLLUP (o_custkey % 4)")
def pir_sharded(spark, sf):
    """The answer of each shard, and of all."""
    return table(spark, sf, "orders").rollup((F.col("o_custkey") % 4).alias("shard")).agg(F.bit_xor("o_orderkey").alias("answer"))


@query("SELECT o_orderkey AS idx, o_custkey AS payload FROM orders")
def pir_field(spark, sf):
    shares = pir.field_shares(table(spark, sf, "orders").select(F.col("o_orderkey").alias("idx"), F.col("o_custkey").alias("payload")))
    return shares.select("idx", F.pmod(F.col("a") + F.col("b"), F.lit(pir.FIELD)).alias("payload"))


@query("SELECT p_partkey, ('0x' || substr(md5(concat('0:', p_partkey)), 1, 8))::BIGINT % 64 AS first, ('0x' || substr(md5(concat('1:', p_partkey)), 1, 8))::BIGINT % 64 AS second FROM part")
def bucketize(spark, sf):
    return table(spark, sf, "part").select("p_partkey", *(pir.bucket_of(F.col("p_partkey"), 64, c).alias(a) for c, a in ((0, "first"), (1, "second"))))


@query("SELECT user_id, event_type, votes FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY votes DESC, event_type) AS r FROM (SELECT user_id, event_type, count(*) AS votes FROM events GROUP BY ALL)) WHERE r = 1")
def robust_majority(spark, sf):
    return pir.majority(table(spark, sf, "events"), "user_id", "event_type")


@query("SELECT n_nationkey, round(pow(1 - 0.9, n_regionkey + 1), 8) AS failure, greatest(2, ceil(ln(0.000001) / ln(1 - (0.5 + n_nationkey / 60.0))))::BIGINT AS servers FROM nation")
def privacy_params(spark, sf):
    q = F.lit(0.5) + F.col("n_nationkey") / F.lit(60.0)
    return table(spark, sf, "nation").select("n_nationkey", F.round(F.pow(F.lit(1 - 0.9), F.col("n_regionkey") + 1), 8).alias("failure"), F.greatest(F.lit(2), F.ceil(F.ln(F.lit(0.000001)) / F.ln(1 - q))).alias("servers"))


@query("SELECT n_nationkey, least(200000, ceil(2 * ln(4 / d) / pow(e * sqrt(2), 2)))::BIGINT AS dimension, ceil(ln(4 / d) / (2 * e * e))::BIGINT AS repeats FROM (SELECT n_nationkey, 0.01 * (n_nationkey + 1) AS e, pow(0.5, n_regionkey + 9) AS d FROM nation)")
def error_budget(spark, sf):
    epsilon, delta = F.lit(0.01) * (F.col("n_nationkey") + 1), F.pow(F.lit(0.5), F.col("n_regionkey") + 9)
    dimension, repeats = pir.repeats_needed(epsilon, delta)
    return table(spark, sf, "nation").select("n_nationkey", dimension.alias("dimension"), repeats.alias("repeats"))


@query("SELECT user_id, event_type, min(event_id) AS first FROM events GROUP BY ALL")
def replay_dedupe(spark, sf):
    """The first of each nonce; a stream keeps them until the watermark passes."""
    return table(spark, sf, "events").groupBy("user_id", "event_type").agg(F.min("event_id").alias("first"))


@query("SELECT w AS window_id, count(*) AS n FROM (SELECT n_nationkey, unnest(range(n_nationkey * 40 // 64, (n_nationkey * 40 + 150) // 64 + 1)) AS w FROM nation) JOIN part ON p_partkey // 64 = w GROUP BY w")
def zoom_windows(spark, sf):
    windows = table(spark, sf, "nation").select(F.explode(F.expr("sequence(n_nationkey * 40 div 64, (n_nationkey * 40 + 150) div 64)")).alias("window_id"))
    return windows.join(table(spark, sf, "part").select(F.expr("p_partkey div 64").alias("window_id")), "window_id").groupBy("window_id").agg(F.count("*").alias("n"))


@query("SELECT tile, n FROM (SELECT l_partkey // 50 AS tile, count(*) AS n FROM lineitem GROUP BY 1) ORDER BY n DESC, tile LIMIT 5")
def zoom_hotspots(spark, sf):
    """The five densest tiles; the limit is the operator."""
    return table(spark, sf, "lineitem").groupBy(F.expr("l_partkey div 50").alias("tile")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "tile").limit(5)


@query("SELECT n_nationkey, i::INT AS i, substr(sha256(concat(n_name, ':', i, ':1024')), 1, 8) AS seed FROM (SELECT n_nationkey, n_name, unnest(range(3)) AS i FROM nation)")
def repeat_seeds(spark, sf):
    each = table(spark, sf, "nation").select("n_nationkey", "n_name", F.explode(F.sequence(F.lit(0), F.lit(2))).alias("i"))
    return each.select("n_nationkey", "i", F.substring(F.sha2(F.concat_ws(":", "n_name", F.col("i").cast("string"), F.lit("1024")), 256), 1, 8).alias("seed"))


@query("SELECT user_id, min(r)::INT AS stop FROM (SELECT user_id, row_number() OVER w AS r, count(*) OVER (PARTITION BY user_id) AS n, stddev_pop(value) OVER w / sqrt(row_number() OVER w) AS se FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING)) WHERE r >= 0.6 * n AND se < 12 GROUP BY user_id")
def early_stop(spark, sf):
    """The first event from 60 % on at which the running error of the mean is below 12."""
    w = W.partitionBy("user_id").orderBy("event_id").rowsBetween(W.unboundedPreceding, 0)
    r = F.count("*").over(w)
    rows = table(spark, sf, "events").select("user_id", r.alias("r"), F.count("*").over(W.partitionBy("user_id")).alias("n"), (F.stddev_pop("value").over(w) / F.sqrt(r)).alias("se"))
    return rows.where("r >= 0.6 * n and se < 12").groupBy("user_id").agg(F.min("r").cast("int").alias("stop"))


LINEAGE = "WITH RECURSIVE e AS (SELECT p_partkey AS child, p_partkey // 2 AS parent FROM part WHERE p_partkey > 0), a AS (SELECT child, parent FROM e UNION ALL SELECT a.child, e.parent FROM a JOIN e ON a.parent = e.child)"


def _parts(spark, sf):
    """Each part below the part of half its key."""
    return table(spark, sf, "part").where("p_partkey > 0").select(F.col("p_partkey").alias("child"), F.expr("p_partkey div 2").alias("parent"))


@query(f"{LINEAGE} SELECT child AS node, count(*) AS ancestors FROM a GROUP BY child")
def lineage_ancestors(spark, sf):
    """How many nodes stand above each."""
    return lineage.lineage(_parts(spark, sf)).select("node", "ancestors")


@query("WITH RECURSIVE w AS (SELECT p_partkey AS node, p_partkey // 2 AS up, p_partkey::VARCHAR AS path FROM part WHERE p_partkey > 0 UNION ALL SELECT node, up // 2, up || '/' || path FROM w WHERE up > 0) SELECT node, '0/' || path AS path FROM w WHERE up = 0")
def lineage_paths(spark, sf):
    """The way from the root down to each node."""
    return lineage.lineage(_parts(spark, sf), paths=True).select("node", F.array_join("path", "/").alias("path"))


@query("SELECT p_size AS parent, count(*) AS children FROM part WHERE p_type <> 'AGGREGATE' GROUP BY p_size HAVING count(*) > 1")
def lineage_forks(spark, sf):
    return table(spark, sf, "part").where("p_type <> 'AGGREGATE'").groupBy(F.col("p_size").alias("parent")).agg(F.count("*").alias("children")).where("children > 1")


@query("SELECT s_suppkey AS shard, j::INT AS replica, (s_suppkey + j) % 7 AS node FROM supplier, (SELECT unnest(range(3)) AS j)")
def shard_placement(spark, sf):
    each = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("shard"), F.explode(F.sequence(F.lit(0), F.lit(2))).alias("replica"))
    return each.select("shard", "replica", F.pmod(F.col("shard") + F.col("replica"), F.lit(7)).alias("node"))


@query("SELECT event_id, event_id % nullif((SELECT count(*) FROM supplier WHERE s_acctbal > 0), 0) AS node FROM events")
def round_robin(spark, sf):
    healthy = table(spark, sf, "supplier").where("s_acctbal > 0").agg(F.count("*").alias("n"))  # one row
    return table(spark, sf, "events").join(F.broadcast(healthy)).select("event_id", (F.col("event_id") % F.nullif(F.col("n"), F.lit(0))).alias("node"))


@query("SELECT l_orderkey, l_linenumber, least(l_orderkey // 4000, 2) AS shard FROM lineitem")
def shard_split(spark, sf):
    """Ranges of keys of one size; the last shard takes the rest."""
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", F.least(F.expr("l_orderkey div 4000"), F.lit(2)).alias("shard"))


@query("SELECT count(*) AS vectors, max(len(embedding)) AS dimension, CASE WHEN bool_and(list_bool_and(list_transform(embedding, lambda x: x IN (0, 1)))) THEN 'hamming' ELSE 'cosine' END AS metric FROM embeddings")
def index_manifest(spark, sf):
    rows = table(spark, sf, "embeddings")
    binary = F.bool_and(F.forall("embedding", lambda x: x.isin(0.0, 1.0)))
    return rows.agg(F.count("*").alias("vectors"), F.max(F.size("embedding")).cast("long").alias("dimension"), F.when(binary, "hamming").otherwise("cosine").alias("metric"))


@query("SELECT vec_id, (i - 1)::INT AS pos, round(e[i] / (sqrt(list_inner_product(e, e)) + 1e-8), 5) AS x FROM (SELECT vec_id, embedding::DOUBLE[] AS e, unnest(range(1, 65)) AS i FROM embeddings)")
def index_build(spark, sf):
    length = V.norm(F.col("embedding")) + 1e-8
    rows = table(spark, sf, "embeddings").select("vec_id", "embedding", length.alias("l"))
    return cells(rows, F.transform("embedding", lambda x: x.cast("double") / F.col("l")), 5)


@query("SELECT vec_id, label FROM embeddings WHERE vec_id < 300 UNION ALL SELECT vec_id, label FROM embeddings WHERE vec_id >= 200")
def index_append(spark, sf):
    """Ids may repeat after an append."""
    rows = table(spark, sf, "embeddings").select("vec_id", "label")
    return rows.where("vec_id < 300").unionByName(rows.where("vec_id >= 200"))


@query("SELECT vec_id, label FROM embeddings WHERE vec_id = 123")
def vector_get(spark, sf):
    return table(spark, sf, "embeddings").where("vec_id = 123").select("vec_id", "label")


@query("SELECT c_custkey, round(-ln(('0x' || substr(md5(concat('5:', c_custkey)), 1, 8))::BIGINT / 4294967296.0::DOUBLE + 1e-12) / c_acctbal, 9) AS key FROM customer WHERE c_acctbal > 500 ORDER BY key, c_custkey LIMIT 20")
def weighted_sample(spark, sf):
    """Twenty customers without replacement, weighted by balance; the limit is the operator."""
    u = F.conv(F.substring(F.md5(F.concat(F.lit("5:"), F.col("c_custkey").cast("string")).cast("binary")), 1, 8), 16, 10).cast("double") / 4294967296.0 + 1e-12
    return table(spark, sf, "customer").where("c_acctbal > 500").select("c_custkey", F.round(-F.ln(u) / F.col("c_acctbal"), 9).alias("key")).orderBy("key", "c_custkey").limit(20)


#: Kilobytes of a genome in each tier; the full one has three kinds of data of 200 each.
TIER_KB = {"mini": 25, "clinical": 300, "full": 3 * 200}


@query("WITH t AS (SELECT c_nationkey, CASE WHEN c_acctbal < 0 THEN 'mini' WHEN c_acctbal < 5000 THEN 'clinical' ELSE 'full' END AS tier FROM customer) SELECT c_nationkey, count(*) AS genomes, sum(CASE tier WHEN 'mini' THEN 25 WHEN 'clinical' THEN 300 ELSE 600 END)::BIGINT AS kb FROM t GROUP BY c_nationkey")
def storage_requirements(spark, sf):
    """What the customers of each nation take, each in the tier of their balance."""
    tier = F.when(F.col("c_acctbal") < 0, TIER_KB["mini"]).when(F.col("c_acctbal") < 5000, TIER_KB["clinical"]).otherwise(TIER_KB["full"])
    return table(spark, sf, "customer").groupBy("c_nationkey").agg(F.count("*").alias("genomes"), F.sum(tier).cast("long").alias("kb"))


@query("SELECT p_partkey FROM part WHERE p_brand IN ('Brand#11', 'Brand#22') ORDER BY p_partkey LIMIT 5000")
def tier_mini(spark, sf):
    """The first 5,000 of a list of brands; the limit is the tier."""
    return table(spark, sf, "part").where(F.col("p_brand").isin("Brand#11", "Brand#22")).orderBy("p_partkey").limit(5000).select("p_partkey")


@query("SELECT p_partkey FROM part WHERE p_brand IN ('Brand#11', 'Brand#22') OR p_size > 45")
def tier_clinical(spark, sf):
    return table(spark, sf, "part").where(F.col("p_brand").isin("Brand#11", "Brand#22") | (F.col("p_size") > 45)).select("p_partkey")
