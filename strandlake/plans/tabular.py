"""Contracts, profiles, joins, filters, sets and aggregates on the star schema."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..operators import contracts, federated, intervals
from ..sources import table

QUERIES, SQL = {}, {}


def query(sql: str):
    def add(f):
        QUERIES[f.__name__], SQL[f.__name__] = f, sql
        return f

    return add


RULES = {"l_quantity": {"allow_null": False, "min": 2, "max": 49}, "l_discount": {"max": 0.08}, "l_returnflag": {"regex": "[AN]"}}


@query("""SELECT unnest(['l_quantity','l_quantity','l_quantity','l_discount','l_returnflag']) AS column_name, unnest(['nulls','min','max','max','regex']) AS rule,
 unnest([count(*) FILTER (l_quantity IS NULL), count(*) FILTER (l_quantity < 2), count(*) FILTER (l_quantity > 49), count(*) FILTER (l_discount > 0.08), count(*) FILTER (NOT regexp_full_match(l_returnflag, '[AN]'))]) AS violations FROM lineitem""")
def contract_report(spark, sf):
    return contracts.column_rules(table(spark, sf, "lineitem"), RULES)


@query("SELECT coalesce(sum(c), 0)::BIGINT AS violations FROM (SELECT count(*) AS c FROM lineitem WHERE l_partkey IS NOT NULL GROUP BY l_partkey HAVING count(*) > 1)")
def contract_unique(spark, sf):
    return contracts.repeated_rows(table(spark, sf, "lineitem"), ["l_partkey"], drop_nulls=True)


@query("SELECT coalesce(sum(c), 0)::BIGINT AS violations FROM (SELECT count(*) AS c FROM lineitem GROUP BY l_suppkey, l_partkey HAVING count(*) > 1)")
def contract_unique_key(spark, sf):
    return contracts.repeated_rows(table(spark, sf, "lineitem"), ["l_suppkey", "l_partkey"])


@query("""SELECT 'l_quantity' AS column_name, count(*) AS n_rows, count(*) FILTER (l_quantity IS NULL) AS n_null, count(DISTINCT l_quantity) AS n_distinct, min(l_quantity)::DOUBLE AS min_value, max(l_quantity)::DOUBLE AS max_value FROM lineitem
UNION ALL SELECT 'l_linenumber', count(*), count(*) FILTER (l_linenumber IS NULL), count(DISTINCT l_linenumber), min(l_linenumber)::DOUBLE, max(l_linenumber)::DOUBLE FROM lineitem""")
def profile_lineitem(spark, sf):
    return contracts.profile(table(spark, sf, "lineitem"), ["l_quantity", "l_linenumber"])


@query("SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events WHERE json_extract(props, '$.k') IS NOT NULL")
def json_extract_k(spark, sf):
    return table(spark, sf, "events").select("event_id", F.get_json_object("props", "$.k").cast("long").alias("k")).where("k is not null")


@query("SELECT p_partkey, unnest(range(p_size, p_size + 3)) AS pos FROM part")
def panel_positions(spark, sf):
    return table(spark, sf, "part").select("p_partkey", F.explode(F.sequence(F.col("p_size").cast("long"), F.col("p_size").cast("long") + 2)).alias("pos"))


@query("SELECT round(avg(l_quantity), 6) AS mean_depth, round(stddev_pop(l_quantity), 6) AS sd_depth, round(avg((l_quantity > 10)::INT), 6) AS covered, median(l_quantity) AS median_depth FROM lineitem")
def coverage_stats(spark, sf):
    q = F.col("l_quantity")
    return table(spark, sf, "lineitem").agg(F.round(F.avg(q), 6).alias("mean_depth"), F.round(F.stddev_pop(q), 6).alias("sd_depth"), F.round(F.avg((q > 10).cast("int")), 6).alias("covered"), F.median(q).alias("median_depth"))


@query("SELECT o_orderkey, o_custkey, o_totalprice FROM orders WHERE o_orderkey = 7")
def variant_lookup(spark, sf):
    return table(spark, sf, "orders").where("o_orderkey = 7").select("o_orderkey", "o_custkey", "o_totalprice")


@query("SELECT r.nation, l.l_orderkey, l.l_linenumber FROM lineitem l JOIN (SELECT n_nationkey AS nation, n_nationkey * 40 AS a, n_nationkey * 40 + 9 AS b FROM nation) r ON l.l_partkey BETWEEN r.a AND r.b")
def region_scan(spark, sf):
    lines = table(spark, sf, "lineitem").select(F.struct("l_orderkey", "l_linenumber").alias("id"), F.lit("1").alias("chrom"), F.col("l_partkey").alias("pos"))
    regions = table(spark, sf, "nation").select(F.col("n_nationkey").alias("region"), F.lit("1").alias("chrom"), (F.col("n_nationkey") * 40).alias("first"), (F.col("n_nationkey") * 40 + 9).alias("last"))
    return intervals.points_in(lines, regions, 64).select(F.col("region").alias("nation"), "id.l_orderkey", "id.l_linenumber")


@query("""WITH a AS (SELECT p_partkey AS id, p_brand AS chrom, p_partkey AS s, p_partkey + p_size AS e FROM part), b AS (SELECT p_partkey AS id, p_brand AS chrom, p_partkey * 2 AS s, p_partkey * 2 + 30 AS e FROM part)
SELECT a.id AS id_a, b.id AS id_b FROM a JOIN b ON a.chrom = b.chrom AND a.s < b.e AND a.e > b.s WHERE a.s < a.e""")
def interval_overlap(spark, sf):
    part = table(spark, sf, "part")
    a = part.select(F.col("p_partkey").alias("id"), F.col("p_brand").alias("chrom"), F.col("p_partkey").alias("start"), (F.col("p_partkey") + F.col("p_size")).alias("end"))
    b = part.select(F.col("p_partkey").alias("id"), F.col("p_brand").alias("chrom"), (F.col("p_partkey") * 2).alias("start"), (F.col("p_partkey") * 2 + 30).alias("end"))
    return intervals.overlaps(a, b, 64)


@query("SELECT c.c_custkey, count(o.o_orderkey) AS n_orders FROM customer c LEFT JOIN orders o ON o.o_custkey = c.c_custkey GROUP BY c.c_custkey")
def one_to_many(spark, sf):
    return table(spark, sf, "customer").join(table(spark, sf, "orders"), F.col("c_custkey") == F.col("o_custkey"), "left").groupBy("c_custkey").agg(F.count("o_orderkey").alias("n_orders"))


@query("SELECT l_orderkey, l_linenumber, l_extendedprice FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_extendedprice DESC, l_linenumber) AS r FROM lineitem) WHERE r <= 2")
def one_to_many_top(spark, sf):
    w = W.partitionBy("l_orderkey").orderBy(F.desc("l_extendedprice"), "l_linenumber")
    return table(spark, sf, "lineitem").withColumn("r", F.row_number().over(w)).where("r <= 2").select("l_orderkey", "l_linenumber", "l_extendedprice")


@query("SELECT l_suppkey, l_orderkey, l_linenumber, l_extendedprice FROM (SELECT *, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber) AS r FROM lineitem) WHERE r <= 10")
def one_to_many_top10(spark, sf):
    w = W.partitionBy("l_suppkey").orderBy(F.desc("l_extendedprice"), "l_orderkey", "l_linenumber")
    return table(spark, sf, "lineitem").withColumn("r", F.row_number().over(w)).where("r <= 10").select("l_suppkey", "l_orderkey", "l_linenumber", "l_extendedprice")


@query("SELECT c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'O')")
def consent_semi(spark, sf):
    return table(spark, sf, "customer").join(table(spark, sf, "orders").where("o_orderstatus = 'O'"), F.col("c_custkey") == F.col("o_custkey"), "left_semi").select("c_custkey")


@query("SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'F' AND o_orderpriority = '1-URGENT')")
def merge_anti(spark, sf):
    """Customers without a closed urgent order."""
    urgent = table(spark, sf, "orders").where("o_orderstatus = 'F' and o_orderpriority = '1-URGENT'")
    return table(spark, sf, "customer").join(urgent, F.col("c_custkey") == F.col("o_custkey"), "left_anti").select("c_custkey")


@query("SELECT o_custkey, max(o_orderdate) AS last_date, arg_max(o_orderkey, (o_orderdate, o_orderkey)) AS last_order FROM orders GROUP BY o_custkey")
def merge_most_recent(spark, sf):
    return table(spark, sf, "orders").groupBy("o_custkey").agg(F.max("o_orderdate").alias("last_date"), F.max_by("o_orderkey", F.struct("o_orderdate", "o_orderkey")).alias("last_order"))


@query("SELECT n_nationkey AS k FROM nation INTERSECT SELECT s_nationkey FROM supplier")
def set_intersect(spark, sf):
    return table(spark, sf, "nation").select(F.col("n_nationkey").alias("k")).intersect(table(spark, sf, "supplier").select("s_nationkey"))


@query("SELECT n_nationkey AS k FROM nation EXCEPT SELECT s_nationkey FROM supplier WHERE s_acctbal > 8000")
def set_except(spark, sf):
    return table(spark, sf, "nation").select(F.col("n_nationkey").alias("k")).subtract(table(spark, sf, "supplier").where("s_acctbal > 8000").select("s_nationkey"))


@query("SELECT l_returnflag, l_linestatus, count(*) AS n, round(sum(l_quantity), 2) AS quantity FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus)")
def cube_flags(spark, sf):
    return table(spark, sf, "lineitem").cube("l_returnflag", "l_linestatus").agg(F.count("*").alias("n"), F.round(F.sum("l_quantity"), 2).alias("quantity"))


@query("SELECT bit_xor(o_custkey) FILTER (o_orderkey % 3 = 0) AS answer, (sum(o_custkey) FILTER (o_orderkey % 3 = 0) % 256)::BIGINT AS answer256 FROM orders")
def pir_answers(spark, sf):
    some = table(spark, sf, "orders").where("o_orderkey % 3 = 0")
    return some.agg(F.bit_xor("o_custkey").alias("answer"), (F.sum("o_custkey") % 256).alias("answer256"))


@query("SELECT user_id, count(*) FILTER (event_type = 'error') AS failures FROM events GROUP BY user_id HAVING count(*) FILTER (event_type = 'error') > 5")
def brute_force(spark, sf):
    return table(spark, sf, "events").where("event_type = 'error'").groupBy("user_id").agg(F.count("*").alias("failures")).where("failures > 5")


@query("""SELECT o_orderstatus, round(sum(sqrt(o_totalprice)), 4) AS power, round(sum(sqrt(o_totalprice)) / (SELECT sum(sqrt(o_totalprice)) FROM orders), 6) AS share FROM orders GROUP BY o_orderstatus""")
def quadratic_vote(spark, sf):
    by = table(spark, sf, "orders").groupBy("o_orderstatus").agg(F.sum(F.sqrt("o_totalprice")).alias("p"))
    return by.select("o_orderstatus", F.round("p", 4).alias("power"), F.round(F.col("p") / F.sum("p").over(W.partitionBy()), 6).alias("share"))


@query("SELECT floor(value / 10)::BIGINT * 10 AS bucket, count(*) AS n FROM events GROUP BY 1")
def latency_hist(spark, sf):
    return table(spark, sf, "events").groupBy((F.floor(F.col("value") / 10) * 10).alias("bucket")).agg(F.count("*").alias("n"))


@query("SELECT p_partkey, CASE WHEN p_retailprice < 1000 THEN 'low' WHEN p_retailprice < 1500 THEN 'medium' ELSE 'high' END AS category FROM part")
def code_category(spark, sf):
    price = F.col("p_retailprice")
    return table(spark, sf, "part").select("p_partkey", F.when(price < 1000, "low").when(price < 1500, "medium").otherwise("high").alias("category"))


@query("WITH m AS (SELECT median(value) AS m FROM events) SELECT m AS median_value, round(median(abs(value - m)), 6) AS mad FROM events, m GROUP BY m")
def median_mad(spark, sf):
    events = table(spark, sf, "events")
    middle = events.agg(F.median("value").alias("m"))
    return events.join(F.broadcast(middle)).groupBy("m").agg(F.round(F.median(F.abs(F.col("value") - F.col("m"))), 6).alias("mad")).select(F.col("m").alias("median_value"), "mad")  # one row


def updates(spark, sf):
    return table(spark, sf, "embeddings").select(F.col("vec_id").alias("client"), F.col("embedding").alias("vector"), (F.col("label") + 1).alias("n"))


POSITIONS = "p AS (SELECT vec_id, label + 1 AS n, unnest(range(64)) AS pos, unnest(embedding)::DOUBLE AS w FROM embeddings)"


@query(f"WITH {POSITIONS} SELECT pos::INT AS pos, round(sum(w * n) / sum(n), 6) AS value FROM p GROUP BY pos")
def fedavg_weighted(spark, sf):
    return federated.weighted_mean(updates(spark, sf)).withColumn("value", F.round("value", 6))


@query(f"WITH {POSITIONS}, r AS (SELECT *, row_number() OVER (PARTITION BY pos ORDER BY w, vec_id) AS r, count(*) OVER (PARTITION BY pos) AS c FROM p) SELECT pos::INT AS pos, round(avg(w), 6) AS value FROM r WHERE r > floor(c * 0.2) AND r <= c - floor(c * 0.2) GROUP BY pos")
def trimmed_mean(spark, sf):
    return federated.trimmed_mean(updates(spark, sf)).withColumn("value", F.round("value", 6))


@query(f"WITH {POSITIONS}, s AS (SELECT pos, sum(w) AS s FROM p GROUP BY pos) SELECT pos::INT AS pos, round(s / (SELECT sqrt(sum(s * s)) FROM s), 6) AS value FROM s")
def bundle_l2(spark, sf):
    return federated.bundle(updates(spark, sf)).withColumn("value", F.round("value", 6))


@query(f"WITH {POSITIONS} SELECT pos::INT AS pos, CASE WHEN sum(w) >= 0 THEN 1 ELSE -1 END AS value FROM p GROUP BY pos")
def bundle_sign(spark, sf):
    return federated.bundle(updates(spark, sf), "sign")


@query(f"WITH {POSITIONS} SELECT pos::INT AS pos, (count(*) FILTER (w > 0) % 2 * 2 - 1)::INT AS value FROM p GROUP BY pos")
def xor_bundle(spark, sf):
    return federated.bundle(updates(spark, sf), "xor")
