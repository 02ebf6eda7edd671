"""Text and key functions, votes, access control, series and encodings on the tables, with the SQL of each."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import vectors as V
from ..operators import sequences, trajectories
from ..sources import table

QUERIES, SQL = {}, {}


def query(sql: str):
    def add(f):
        QUERIES[f.__name__], SQL[f.__name__] = f, sql
        return f

    return add


@query("SELECT doc_id, len(text) - len(replace(replace(lower(text), 'g', ''), 'c', '')) AS gc, contains(upper(text), 'CG') AS has_cg FROM documents")
def gc_content(spark, sf):
    text = F.lower("text")
    return table(spark, sf, "documents").select("doc_id", (F.length("text") - F.length(F.translate(text, "gc", ""))).cast("long").alias("gc"), F.upper("text").contains("CG").alias("has_cg"))


@query("SELECT n_name AS name, CASE WHEN len(n_name) = len(r_name) THEN 'SNV' WHEN len(n_name) < len(r_name) THEN 'INS' ELSE 'DEL' END AS type FROM nation JOIN region ON n_regionkey = r_regionkey")
def variant_type(spark, sf):
    named = table(spark, sf, "nation").join(table(spark, sf, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    ref, alt = F.length("n_name"), F.length("r_name")
    return named.select(F.col("n_name").alias("name"), F.when(ref == alt, "SNV").when(ref < alt, "INS").otherwise("DEL").alias("type"))


@query("SELECT p_partkey, regexp_extract(p_brand, '#([0-9])([0-9])', 1) AS major, regexp_extract(p_brand, '#([0-9])([0-9])', 2) AS minor FROM part")
def parse_string(spark, sf):
    return table(spark, sf, "part").select("p_partkey", *(F.regexp_extract("p_brand", "#([0-9])([0-9])", i).alias(c) for i, c in ((1, "major"), (2, "minor"))))


@query("SELECT p_partkey, substr(sha256(concat(p_name, ':', p_brand)), 1, 16) AS attestation_id FROM part")
def attestation_id(spark, sf):
    return table(spark, sf, "part").select("p_partkey", F.substring(F.sha2(F.concat("p_name", F.lit(":"), "p_brand"), 256), 1, 16).alias("attestation_id"))


@query("SELECT n_nationkey, sha256(n_name) AS hash FROM nation")
def sha256_rows(spark, sf):
    return table(spark, sf, "nation").select("n_nationkey", F.sha2("n_name", 256).alias("hash"))


@query("SELECT p_partkey, i::INT AS pos, substr(p_name, i, 3) AS gram FROM (SELECT p_partkey, p_name, unnest(range(1, len(p_name) - 1)) AS i FROM part)")
def trigrams(spark, sf):
    at = F.explode(F.expr("sequence(1, length(p_name) - 2)")).alias("pos")
    return table(spark, sf, "part").where("length(p_name) > 2").select("p_partkey", "p_name", at).select("p_partkey", "pos", F.expr("substr(p_name, pos, 3)").alias("gram"))


@query("SELECT o_orderkey, concat('chr', o_custkey, chr(9), o_orderkey, chr(9), o_orderkey + 1, chr(9), (floor(o_totalprice))::BIGINT) AS line FROM orders")
def bedgraph_rows(spark, sf):
    line = F.concat_ws("\t", F.concat(F.lit("chr"), "o_custkey"), "o_orderkey", F.col("o_orderkey") + 1, F.floor("o_totalprice"))
    return table(spark, sf, "orders").select("o_orderkey", line.alias("line"))


@query("SELECT c_custkey, coalesce(nullif(c_mktsegment, 'BUILDING'), 'UNKNOWN') AS segment FROM customer")
def merge_coalesce(spark, sf):
    return table(spark, sf, "customer").select("c_custkey", F.coalesce(F.nullif("c_mktsegment", F.lit("BUILDING")), F.lit("UNKNOWN")).alias("segment"))


@query("SELECT s_suppkey AS id, 'supplier' AS kind FROM supplier UNION ALL SELECT c_custkey, 'customer' FROM customer")
def merge_union(spark, sf):
    rows = lambda name, key: table(spark, sf, name).select(F.col(key).alias("id"), F.lit(name).alias("kind"))
    return rows("supplier", "s_suppkey").unionByName(rows("customer", "c_custkey"))


@query("SELECT c_custkey FROM customer WHERE c_acctbal BETWEEN 1000 AND 5000 AND c_mktsegment IN ('BUILDING', 'MACHINERY')")
def eligibility(spark, sf):
    return table(spark, sf, "customer").where(F.col("c_acctbal").between(1000, 5000) & F.col("c_mktsegment").isin("BUILDING", "MACHINERY")).select("c_custkey")


@query("SELECT c_custkey, CASE WHEN c_acctbal < 0 THEN 'L' WHEN c_acctbal > 9000 THEN 'H' ELSE 'N' END AS flag FROM customer")
def abnormal_flag(spark, sf):
    c = F.col("c_acctbal")
    return table(spark, sf, "customer").select("c_custkey", F.when(c < 0, "L").when(c > 9000, "H").otherwise("N").alias("flag"))


@query("SELECT user_id, event_type AS scope, bool_or(value > 450) AS active FROM events GROUP BY user_id, event_type")
def consent_state(spark, sf):
    return table(spark, sf, "events").groupBy("user_id", F.col("event_type").alias("scope")).agg(F.bool_or(F.col("value") > 450).alias("active"))


@query("SELECT user_id, CASE WHEN neg >= 12 THEN 'DISPUTED' WHEN pos > neg AND pos >= n // 2 THEN 'VERIFIED' ELSE 'PENDING' END AS status FROM (SELECT user_id, count(*) AS n, count(*) FILTER (value > 200) AS pos, count(*) FILTER (value < 100) AS neg FROM events GROUP BY user_id)")
def attestation_status(spark, sf):
    by = table(spark, sf, "events").groupBy("user_id").agg(F.count("*").alias("n"), F.count_if(F.col("value") > 200).alias("pos"), F.count_if(F.col("value") < 100).alias("neg"))
    return by.select("user_id", F.when(F.col("neg") >= 12, "DISPUTED").when((F.col("pos") > F.col("neg")) & (F.col("pos") >= F.expr("n div 2")), "VERIFIED").otherwise("PENDING").alias("status"))


@query("SELECT user_id, arg_max(event_type, (c, -first)) AS winner FROM (SELECT user_id, event_type, count(*) AS c, min(event_id) AS first FROM events GROUP BY user_id, event_type) GROUP BY user_id")
def majority_vote(spark, sf):
    """The most common type of each user; of equally common ones the one seen first."""
    counts = table(spark, sf, "events").groupBy("user_id", "event_type").agg(F.count("*").alias("c"), F.min("event_id").alias("first"))
    return counts.groupBy("user_id").agg(F.max_by("event_type", F.struct("c", -F.col("first"))).alias("winner"))


@query("WITH s AS (SELECT s_nationkey % 5 AS boss, sum(s_acctbal) AS p FROM supplier GROUP BY 1) SELECT n_nationkey AS node, round(coalesce((SELECT sum(s_acctbal) FROM supplier WHERE s_nationkey = n_nationkey), 0) + coalesce(p, 0), 2) AS power FROM nation LEFT JOIN s ON boss = n_nationkey")
def delegated_power(spark, sf):
    """A node's own power and that of those who delegate to it, over one hop."""
    own = table(spark, sf, "supplier").select(F.explode(F.array("s_nationkey", F.col("s_nationkey") % 5)).alias("node"), "s_acctbal").groupBy("node").agg(F.sum("s_acctbal").alias("p"))
    return table(spark, sf, "nation").select(F.col("n_nationkey").alias("node")).join(own, "node", "left").select("node", F.round(F.coalesce("p", F.lit(0.0)), 2).alias("power"))


@query("SELECT s_suppkey, kind, rank FROM (SELECT s_suppkey, s_nationkey % 2 AS kind, row_number() OVER (PARTITION BY s_nationkey % 2 ORDER BY s_acctbal, s_suppkey) AS rank FROM supplier) WHERE rank <= 3")
def nearest_nodes(spark, sf):
    nodes = table(spark, sf, "supplier").withColumn("kind", F.col("s_nationkey") % 2)
    w = W.partitionBy("kind").orderBy("s_acctbal", "s_suppkey")
    return nodes.withColumn("rank", F.row_number().over(w)).where("rank <= 3").select("s_suppkey", "kind", "rank")


@query("SELECT l_suppkey % 7 AS shard, count(*) AS items, min(l_orderkey) AS first, max(l_orderkey) AS last FROM lineitem GROUP BY ROLLUP (l_suppkey % 7)")
def shard_stats(spark, sf):
    return table(spark, sf, "lineitem").rollup((F.col("l_suppkey") % 7).alias("shard")).agg(F.count("*").alias("items"), F.min("l_orderkey").alias("first"), F.max("l_orderkey").alias("last"))


@query("SELECT l_partkey // 100 AS tile, count(*) AS n, count(DISTINCT l_suppkey) AS suppliers FROM lineitem GROUP BY 1")
def zoom_tiles(spark, sf):
    return table(spark, sf, "lineitem").groupBy(F.expr("l_partkey div 100").alias("tile")).agg(F.count("*").alias("n"), F.countDistinct("l_suppkey").alias("suppliers"))


@query("SELECT event_id, i // 90 AS slice FROM (SELECT event_id, event_id AS i FROM events) UNION ALL SELECT event_id, event_id // 90 - 1 FROM events WHERE event_id % 90 < 10 AND event_id >= 90")
def overlapping_slices(spark, sf):
    """Slices of 100 events, the next one 90 further: an event within ten of a slice's start is in the one before as well."""
    both = F.when((F.col("event_id") % 90 < 10) & (F.col("event_id") >= 90), F.expr("array(event_id div 90, event_id div 90 - 1)")).otherwise(F.expr("array(event_id div 90)"))
    return table(spark, sf, "events").select("event_id", F.explode(both).alias("slice"))


@query("SELECT user_id, count(*) AS n, round(avg(value), 6) AS mean, round(var_pop(value) * count(*), 3) AS m2 FROM events GROUP BY user_id")
def welford_state(spark, sf):
    return table(spark, sf, "events").groupBy("user_id").agg(F.count("*").alias("n"), F.round(F.avg("value"), 6).alias("mean"), F.round(F.var_pop("value") * F.count("*"), 3).alias("m2"))


@query("SELECT CAST(date_trunc('day', ts) AS TIMESTAMP) AS day, event_type, count(*) AS n FROM events GROUP BY ALL")
def tumbling_day(spark, sf):
    return table(spark, sf, "events").groupBy(F.date_trunc("day", "ts").cast("timestamp_ntz").alias("day"), "event_type").agg(F.count("*").alias("n"))


@query("SELECT user_id, count(*) FILTER (p IS NULL OR ts - p > INTERVAL 6 HOUR) AS sessions FROM (SELECT user_id, ts, lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS p FROM events) GROUP BY user_id")
def session_gap(spark, sf):
    before = F.lag("ts").over(W.partitionBy("user_id").orderBy("ts", "event_id"))
    gaps = table(spark, sf, "events").select("user_id", "ts", before.alias("p"))
    return gaps.groupBy("user_id").agg(F.count_if(F.col("p").isNull() | (F.col("ts") - F.col("p") > F.expr("INTERVAL '6' HOUR"))).alias("sessions"))


@query("SELECT event_type, round(regr_slope(value, event_id), 8) AS slope, round(corr(value, event_id), 8) AS r FROM events GROUP BY event_type")
def recent_trend(spark, sf):
    return table(spark, sf, "events").groupBy("event_type").agg(F.round(F.regr_slope("value", "event_id"), 8).alias("slope"), F.round(F.corr("value", "event_id"), 8).alias("r"))


@query("SELECT vec_id, round(1 - list_cosine_similarity(embedding::DOUBLE[], p::DOUBLE[]), 5) AS drift FROM (SELECT vec_id, label, embedding, lag(embedding) OVER (PARTITION BY label ORDER BY vec_id) AS p FROM embeddings) WHERE p IS NOT NULL")
def drift_series(spark, sf):
    rows = sequences.beside_previous(table(spark, sf, "embeddings").select("vec_id", "label", "embedding"), "label", "vec_id", "embedding", "p")
    return rows.where("p is not null").select("vec_id", F.round(1 - V.cosine(F.col("embedding"), F.col("p")), 5).alias("drift"))


@query("""WITH d AS (SELECT vec_id, label, 1 - list_cosine_similarity(embedding::DOUBLE[], lag(embedding) OVER (PARTITION BY label ORDER BY vec_id)::DOUBLE[]) AS d FROM embeddings QUALIFY d IS NOT NULL),
r AS (SELECT *, CASE WHEN count(*) OVER w = 5 THEN avg(d) OVER w END AS rolling FROM d WINDOW w AS (PARTITION BY label ORDER BY vec_id ROWS 4 PRECEDING))
SELECT vec_id, d > 1.1 AS flagged, round(rolling, 5) AS rolling, coalesce(rolling > 0.99, FALSE) AS sustained FROM r""")
def drift_flags(spark, sf):
    """Drift from vector to vector of a label above 1.1, and where its mean over five is above nine tenths of that."""
    rows = table(spark, sf, "embeddings").select("vec_id", "label", "embedding")
    return trajectories.drift_flags(rows, "label", "vec_id", "embedding", 1.1, 5, 0.9).select("vec_id", "flagged", F.round("rolling", 5).alias("rolling"), F.coalesce("sustained", F.lit(False)).alias("sustained"))


@query("""WITH s AS (SELECT label, vec_id, embedding::DOUBLE[] AS e, lag(embedding) OVER w::DOUBLE[] AS p, lag(embedding, 2) OVER w::DOUBLE[] AS q FROM embeddings WINDOW w AS (PARTITION BY label ORDER BY vec_id)),
t AS (SELECT *, list_transform(range(1, 65), lambda i: coalesce(e[i] - p[i], 0)) AS a, list_transform(range(1, 65), lambda i: coalesce(p[i] - q[i], 0)) AS b FROM s),
u AS (SELECT label, list_distance(e, p) AS length, CASE WHEN q IS NOT NULL THEN acos(greatest(-1, least(1, list_inner_product(a, b) / (sqrt(list_inner_product(a, a)) * sqrt(list_inner_product(b, b)) + 1e-8)))) END AS angle FROM t),
f AS (SELECT label, count(*) AS n, list_distance(arg_max(embedding, vec_id)::DOUBLE[], arg_min(embedding, vec_id)::DOUBLE[]) AS direct FROM embeddings GROUP BY label)
SELECT label, any_value(n) AS n, round(sum(length), 4) AS path, round(any_value(direct), 5) AS direct, round(any_value(direct) / (sum(length) + 1e-8), 6) AS efficiency, round(avg(angle), 5) AS avg_curvature, round(max(angle), 5) AS max_curvature FROM u JOIN f USING (label) GROUP BY label HAVING any_value(n) >= 3""")
def trajectory_shape(spark, sf):
    """The way through each label's vectors: its length, how straight it is and how it turns."""
    found = trajectories.shape(table(spark, sf, "embeddings"), "label", "vec_id", "embedding").where("n >= 3")
    return found.select("label", "n", F.round("path", 4).alias("path"), *(F.round(c, d).alias(c) for c, d in (("direct", 5), ("efficiency", 6), ("avg_curvature", 5), ("max_curvature", 5))))


@query("SELECT vec_id, list_transform(embedding[1:8], lambda x: round(x::DOUBLE * 127)::INT)::VARCHAR AS q FROM embeddings")
def quantize_int8(spark, sf):
    """The first eight components in steps of 1/127, written as a list."""
    q = F.transform(F.slice("embedding", 1, 8), lambda x: F.round(x.cast("double") * 127).cast("int").cast("string"))
    return table(spark, sf, "embeddings").select("vec_id", F.concat(F.lit("["), F.array_join(q, ", "), F.lit("]")).alias("q"))


@query("""WITH s AS (SELECT vec_id, embedding, greatest(list_max(list_transform(embedding, lambda x: abs(x::DOUBLE))), 1e-8) AS top FROM embeddings)
SELECT vec_id, pos::INT AS pos, round_even(x::DOUBLE / top * 127, 0)::INT AS q FROM (SELECT vec_id, top, unnest(range(len(embedding))) AS pos, unnest(embedding) AS x FROM s)""")
def quantize_int8_all(spark, sf):
    """Every component in steps of 1/127 of its vector's largest, halves to even."""
    top = F.greatest(F.array_max(F.transform("embedding", lambda x: F.abs(x.cast("double")))), F.lit(1e-8))
    cells = table(spark, sf, "embeddings").select("vec_id", top.alias("top"), F.posexplode("embedding").alias("pos", "x"))
    return cells.select("vec_id", "pos", F.bround(F.col("x").cast("double") / F.col("top") * 127).cast("int").alias("q"))


@query("SELECT vec_id, lane::INT AS lane, sum(CASE WHEN x > 0 THEN 1::BIGINT << (pos % 32)::INT ELSE 0 END)::BIGINT AS bits FROM (SELECT vec_id, unnest(range(64)) AS pos, unnest(embedding) AS x, unnest(range(64)) // 32 AS lane FROM embeddings) GROUP BY vec_id, lane")
def pack_bits(spark, sf):
    """Signs as bits, the lowest first, in lanes of 32."""
    bit = lambda x, i: F.when(x > 0, F.call_function("shiftleft", F.lit(1).cast("long"), i)).otherwise(F.lit(0).cast("long"))
    lane = lambda k: F.aggregate(F.transform(F.slice("embedding", 32 * k + 1, 32), bit), F.lit(0).cast("long"), lambda a, x: a + x)
    return table(spark, sf, "embeddings").select("vec_id", F.posexplode(F.array(lane(0), lane(1))).alias("lane", "bits"))


@query("SELECT label, pos // 3 AS block, (count(*) FILTER (x > 0) % 2)::BIGINT AS parity FROM (SELECT label, unnest(range(64)) AS pos, unnest(embedding) AS x FROM embeddings) GROUP BY label, block")
def ecc_parity(spark, sf):
    cells = table(spark, sf, "embeddings").select("label", F.posexplode("embedding").alias("pos", "x"))
    return cells.groupBy("label", F.expr("cast(pos div 3 as bigint)").alias("block")).agg((F.count_if(F.col("x") > 0) % 2).alias("parity"))


@query("SELECT l_suppkey, round(sum(l_quantity * l_discount) , 4) AS score, round(1 / (1 + exp(-avg(ln(1 + l_tax)))), 6) AS odds FROM lineitem GROUP BY l_suppkey")
def prs_score(spark, sf):
    by = table(spark, sf, "lineitem").groupBy("l_suppkey")
    return by.agg(F.round(F.sum(F.col("l_quantity") * F.col("l_discount")), 4).alias("score"), F.round(1 / (1 + F.exp(-F.avg(F.ln(1 + F.col("l_tax"))))), 6).alias("odds"))


@query("""WITH g AS (SELECT l_partkey AS part, l_returnflag = 'A' AS a, ln(l_extendedprice + 1) / ln(2) AS x FROM lineitem WHERE l_returnflag IN ('A', 'R')),
s AS (SELECT part, count(*) FILTER (a) AS na, count(*) FILTER (NOT a) AS nr, avg(x) FILTER (a) AS ma, avg(x) FILTER (NOT a) AS mr, var_samp(x) FILTER (a) AS va, var_samp(x) FILTER (NOT a) AS vr FROM g GROUP BY part)
SELECT part, round(ma - mr, 6) AS log2fc, round((ma - mr) / sqrt(((na - 1) * va + (nr - 1) * vr) / (na + nr - 2) * (1.0 / na + 1.0 / nr)), 5) AS t FROM s WHERE na >= 2 AND nr >= 2 AND va + vr > 1e-9""")
def diff_expression(spark, sf):
    """Pooled t statistics of log2 values, in one grouping with a conditional aggregate for each side."""
    x = F.log2(F.col("l_extendedprice") + 1)
    of = lambda flag: F.when(F.col("l_returnflag") == flag, x)
    stats = [f(of(flag)).alias(f"{k}{flag}") for flag in "AR" for k, f in (("n", F.count), ("m", F.avg), ("v", F.var_samp))]
    by = table(spark, sf, "lineitem").where(F.col("l_returnflag").isin("A", "R")).groupBy(F.col("l_partkey").alias("part")).agg(*stats).where("nA >= 2 and nR >= 2 and vA + vR > 1e-9")
    return by.select("part", F.expr("round(mA - mR, 6)").alias("log2fc"), F.expr("round((mA - mR) / sqrt(((nA - 1) * vA + (nR - 1) * vR) / (nA + nR - 2) * (1.0D / nA + 1.0D / nR)), 5)").alias("t"))


@query("SELECT o_orderkey, (row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) - 1) // 5 AS chunk FROM orders")
def chunk_rows(spark, sf):
    w = W.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    return table(spark, sf, "orders").select("o_orderkey", ((F.row_number().over(w) - 1) / 5).cast("long").alias("chunk"))


@query("SELECT conv_id, arg_min(role, turn) AS first_role, count(*) AS turns, max(len(text)) AS longest FROM conversations GROUP BY conv_id")
def measurement_summary(spark, sf):
    return table(spark, sf, "conversations").groupBy("conv_id").agg(F.min_by("role", "turn").alias("first_role"), F.count("*").alias("turns"), F.max(F.length("text")).cast("long").alias("longest"))
