"""Incoming tables, genomic lookups, graphs and panels on the tables, with the SQL of each."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import etl, genomics, intervals
from ..sources import table

QUERIES, SQL = {}, {}


def query(sql: str):
    def add(f):
        QUERIES[f.__name__], SQL[f.__name__] = f, sql
        return f

    return add


@query("SELECT n_nationkey AS sample_id, n_regionkey AS chrom, n_name AS pos FROM nation")
def etl_transform(spark, sf):
    raw = table(spark, sf, "nation").select(F.col("n_nationkey").alias(" Sample"), F.col("n_regionkey").alias("Chromosome"), F.col("n_name").alias("POSITION "))
    return etl.standardized(raw)


@query("SELECT p_partkey, TRY_CAST(substr(p_brand, 7) AS INT) AS brand, TRY_CAST(p_name AS DOUBLE) AS name_number, TRY_CAST(p_size AS VARCHAR) AS size FROM part")
def contract_coerce(spark, sf):
    raw = table(spark, sf, "part").select("p_partkey", F.expr("substr(p_brand, 7)").alias("brand"), F.col("p_name").alias("name_number"), F.col("p_size").alias("size"))
    return etl.coerced(raw, {"brand": "int", "name_number": "double", "size": "string", "absent": "int"})


@query("SELECT c_custkey, CASE WHEN c_acctbal < 0 THEN 'balance' WHEN c_mktsegment = 'BUILDING' THEN 'segment' END AS missing FROM customer")
def batch_required(spark, sf):
    fields = {"name": F.col("c_name"), "balance": F.when(F.col("c_acctbal") >= 0, F.col("c_acctbal")), "segment": F.nullif("c_mktsegment", F.lit("BUILDING"))}
    return table(spark, sf, "customer").select("c_custkey", etl.first_missing(fields).alias("missing"))


@query("SELECT 'l_absent' AS column_name, 'missing_column' AS rule, 1::BIGINT AS violations UNION ALL SELECT 'l_empty', 'all_null', (count(*) >= 0)::BIGINT FROM lineitem")
def contract_structure(spark, sf):
    return etl.structure_rules(table(spark, sf, "lineitem").withColumn("l_empty", F.lit(None).cast("int")), ["l_orderkey", "l_absent", "l_empty"])


@query("SELECT count(*) FILTER (l_discount IS NULL) AS violations FROM lineitem")
def contract_nulls(spark, sf):
    return table(spark, sf, "lineitem").agg(F.count_if(F.col("l_discount").isNull()).alias("violations"))


@query("SELECT count(*) FILTER (NOT regexp_full_match(p_brand, 'Brand#[1-4][0-9]')) AS violations FROM part")
def contract_regex(spark, sf):
    return table(spark, sf, "part").agg(F.count_if(~F.col("p_brand").rlike("^(?:Brand#[1-4][0-9])$")).alias("violations"))


@query("SELECT count(*) FILTER (p_size < 5) AS below, count(*) FILTER (p_size > 45) AS above FROM part")
def contract_range(spark, sf):
    return table(spark, sf, "part").agg(F.count_if(F.col("p_size") < 5).alias("below"), F.count_if(F.col("p_size") > 45).alias("above"))


@query("SELECT l_orderkey, l_linenumber, CASE WHEN l_discount > 0 THEN round(l_discount, 1) END AS d, CASE WHEN l_tax > 0 THEN round(l_tax, 1) END AS t FROM lineitem")
def compact_struct(spark, sf):
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", *(etl.positive(F.col(c)).alias(a) for c, a in (("l_discount", "d"), ("l_tax", "t"))))


@query("SELECT p_partkey, 'ratio' AS measure, round(p_retailprice / (p_size * p_size), 1) AS value FROM part WHERE p_size > 0")
def derived_ratio(spark, sf):
    return etl.with_ratio(table(spark, sf, "part"), "p_partkey", "ratio", F.col("p_retailprice"), F.col("p_size"))


@query("SELECT count(*) AS n FROM (SELECT unnest(string_split(text, chr(10))) AS line FROM documents) WHERE starts_with(line, 'The ')")
def line_prefix_count(spark, sf):
    return table(spark, sf, "documents").select(F.explode(F.split("text", "\n")).alias("line")).where(F.col("line").startswith("The ")).agg(F.count("*").alias("n"))


F_SQL = "f AS (SELECT l_partkey AS part, l_returnflag AS population, round(avg(l_discount), 6) AS frequency FROM lineitem GROUP BY ALL)"


def _frequencies(spark, sf):
    return table(spark, sf, "lineitem").groupBy(F.col("l_partkey").alias("part"), F.col("l_returnflag").alias("population")).agg(F.round(F.avg("l_discount"), 6).alias("frequency"))


@query(f"WITH {F_SQL} SELECT p_partkey AS part, coalesce(frequency, 0) AS frequency FROM part LEFT JOIN f ON part = p_partkey AND population = 'A'")
def population_frequency(spark, sf):
    return genomics.population_frequency(table(spark, sf, "part").select(F.col("p_partkey").alias("part")), _frequencies(spark, sf), ["part"], "A")


@query("SELECT p_partkey AS pos FROM part WHERE p_partkey BETWEEN 10 AND 900 AND (p_brand = 'Brand#13' OR p_type = 'Brand#13')")
def nodes_in_region(spark, sf):
    nodes = table(spark, sf, "part").select(F.col("p_partkey").alias("pos"), F.array("p_brand", "p_type").alias("populations"))
    return genomics.nodes_in_region(nodes, 10, 900, "Brand#13").select("pos")


GENES = "g AS (SELECT n_nationkey AS region, n_nationkey * 40 AS a, n_nationkey * 40 + 9 AS b FROM nation)"


def _genes(spark, sf):
    return table(spark, sf, "nation").select(F.col("n_nationkey").alias("region"), F.lit("1").alias("chrom"), (F.col("n_nationkey") * 40).alias("first"), (F.col("n_nationkey") * 40 + 9).alias("last"))


def _variants(spark, sf):
    return table(spark, sf, "lineitem").select(F.struct("l_orderkey", "l_linenumber", F.col("l_returnflag").alias("impact")).alias("id"), F.lit("1").alias("chrom"), F.col("l_partkey").alias("pos"))


@query(f"WITH {GENES} SELECT region, count(*) AS total, count(*) FILTER (l_returnflag IN ('A', 'R')) AS matching FROM lineitem JOIN g ON l_partkey BETWEEN a AND b GROUP BY region")
def gene_annotation(spark, sf):
    return genomics.gene_annotation(_genes(spark, sf), _variants(spark, sf), ["A", "R"], 64)


@query(f"WITH {GENES} SELECT region, l_orderkey, l_linenumber FROM lineitem JOIN g ON l_partkey BETWEEN a AND b WHERE region IN (1, 3, 7) AND l_returnflag = 'R'")
def clinical_variants(spark, sf):
    met = intervals.points_in(_variants(spark, sf), _genes(spark, sf).where(F.col("region").isin(1, 3, 7)), 64)
    return met.where("id.impact = 'R'").select("region", "id.l_orderkey", "id.l_linenumber")


@query("""WITH r AS (SELECT n_nationkey AS id, n_nationkey * 50 AS s, n_nationkey * 50 + 120 AS e FROM nation), h AS (SELECT s_suppkey AS id, s_suppkey * 100 AS s, s_suppkey * 100 + 100 AS e FROM supplier)
SELECT r.id AS id_a, h.id AS id_b FROM r JOIN h ON r.s < h.e AND r.e > h.s""")
def shard_prune(spark, sf):
    span = lambda name, key, step, size: table(spark, sf, name).select(F.col(key).alias("id"), F.lit("1").alias("chrom"), (F.col(key) * step).alias("start"), (F.col(key) * step + size).alias("end"))
    return intervals.overlaps(span("nation", "n_nationkey", 50, 120), span("supplier", "s_suppkey", 100, 100), 128)


@query("SELECT l_orderkey, l_linenumber, l_partkey AS pos FROM lineitem WHERE l_partkey IN (SELECT p_partkey FROM part WHERE p_size = 7)")
def panel_join(spark, sf):
    panel = table(spark, sf, "part").where("p_size = 7").select(F.col("p_partkey").alias("l_partkey"))
    return table(spark, sf, "lineitem").join(panel, "l_partkey").select("l_orderkey", "l_linenumber", F.col("l_partkey").alias("pos"))


@query("SELECT a, b, count(*) AS support FROM (SELECT l_suppkey AS a, l_partkey % 50 AS b FROM lineitem) JOIN supplier x ON x.s_suppkey = a JOIN supplier y ON y.s_suppkey = b GROUP BY a, b")
def edge_support(spark, sf):
    nodes = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("node"), F.col("s_nationkey").alias("pos"))
    edges = table(spark, sf, "lineitem").groupBy(F.col("l_suppkey").alias("a"), (F.col("l_partkey") % 50).alias("b")).agg(F.count("*").alias("support"))
    return genomics.edge_support(edges, nodes).select("a", "b", "support")


@query("SELECT n_name AS population, count(*) AS nodes, count(DISTINCT c_mktsegment) AS segments, round(avg(c_acctbal), 4) AS mean FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY n_name")
def population_agg(spark, sf):
    named = table(spark, sf, "customer").join(table(spark, sf, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    return named.groupBy(F.col("n_name").alias("population")).agg(F.count("*").alias("nodes"), F.count_distinct("c_mktsegment").alias("segments"), F.round(F.avg("c_acctbal"), 4).alias("mean"))


@query("SELECT p_brand AS chrom, p_size AS size, count(*) AS n, round(sum(p_retailprice), 2) AS length FROM part GROUP BY GROUPING SETS ((p_brand), (p_size), ())")
def graph_stats(spark, sf):
    by = table(spark, sf, "part").groupingSets([["p_brand"], ["p_size"], []], "p_brand", "p_size").agg(F.count("*").alias("n"), F.round(F.sum("p_retailprice"), 2).alias("length"))
    return by.select(F.col("p_brand").alias("chrom"), F.col("p_size").alias("size"), "n", "length")


@query("SELECT p_size AS pos, string_agg(p_partkey::VARCHAR, ',' ORDER BY p_partkey) AS indices FROM part GROUP BY p_size")
def inverted_index(spark, sf):
    ids = F.array_join(F.transform(F.sort_array(F.collect_list("p_partkey")), lambda x: x.cast("string")), ",")
    return table(spark, sf, "part").groupBy(F.col("p_size").alias("pos")).agg(ids.alias("indices"))


@query("SELECT p_brand AS pathway, count(*) AS size, count(*) FILTER (d) AS overlap, round(count(*) FILTER (d) / count(*), 6) AS enrichment FROM (SELECT p_brand, p_partkey IN (SELECT l_partkey FROM lineitem WHERE l_quantity > 45) AS d FROM part) GROUP BY p_brand")
def pathway_enrichment(spark, sf):
    pathways = table(spark, sf, "part").select(F.col("p_brand").alias("pathway"), F.col("p_partkey").alias("member"))
    detected = table(spark, sf, "lineitem").where("l_quantity > 45").select(F.col("l_partkey").alias("member"))
    return genomics.enrichment(pathways, detected).withColumn("enrichment", F.round("enrichment", 6))


@query("SELECT l_suppkey, n, round(coalesce(s, 0.5), 5) AS score, round(greatest(0, s - h), 5) AS low, round(least(1, s + h), 5) AS high FROM (SELECT l_suppkey, count(*) AS n, 1 / (1 + exp(-10 * avg(ln(1 + l_tax)))) AS s, 0.196::DOUBLE / sqrt(count(*) + 1) AS h FROM lineitem GROUP BY l_suppkey)")
def prs_logodds(spark, sf):
    matches = table(spark, sf, "lineitem").select("l_suppkey", (1 + F.col("l_tax")).alias("odds"))
    return genomics.log_odds_score(matches, "l_suppkey", "odds").select("l_suppkey", "n", *(F.round(c, 5).alias(c) for c in ("score", "low", "high")))


@query("SELECT l_suppkey, round(coalesce(sum(l_quantity * p_size) FILTER (p_size < 10), 0), 2) AS burden FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY l_suppkey")
def rare_burden(spark, sf):
    met = table(spark, sf, "lineitem").join(table(spark, sf, "part"), F.col("l_partkey") == F.col("p_partkey"))
    return met.groupBy("l_suppkey").agg(F.round(F.coalesce(F.sum(F.when(F.col("p_size") < 10, F.col("l_quantity") * F.col("p_size"))), F.lit(0.0)), 2).alias("burden"))


@query("SELECT c_nationkey, round(coalesce(count(*) FILTER (c_acctbal > 3000) / nullif(count(*), 0), 0), 6) AS risk FROM customer GROUP BY c_nationkey")
def panel_risk(spark, sf):
    return table(spark, sf, "customer").groupBy("c_nationkey").agg(F.round(F.avg((F.col("c_acctbal") > 3000).cast("int")), 6).alias("risk"))


@query("SELECT c_custkey, CASE WHEN regexp_full_match(c_custkey::VARCHAR, '([1-9]|1[0-9]|2[0-2])') THEN concat('chr', c_custkey) END AS chrom FROM customer")
def normalize_key(spark, sf):
    return table(spark, sf, "customer").select("c_custkey", genomics.chromosome(F.concat(F.lit(" Chr"), F.col("c_custkey"))).alias("chrom"))


@query("SELECT l_partkey, CASE WHEN avg(l_quantity) >= 20 THEN round(avg(l_quantity), 6) END AS quality FROM lineitem GROUP BY l_partkey")
def quality_score(spark, sf):
    mean = F.avg("l_quantity")
    return table(spark, sf, "lineitem").groupBy("l_partkey").agg(F.when(mean >= 20, F.round(mean, 6)).alias("quality"))


@query("SELECT doc_id, round(list_sum(list_transform(regexp_extract_all(lower(text), '(t{2,}|s{2,}|e{2,}|l{2,})'), lambda x: len(x)))::DOUBLE / nullif(len(text), 0), 6) AS share FROM documents WHERE regexp_matches(lower(text), '(t{2,}|s{2,}|e{2,}|l{2,})')")
def homopolymer(spark, sf):
    share = genomics.homopolymer_share(F.lower("text"), "tsel", 2)
    return table(spark, sf, "documents").select("doc_id", F.round(share, 6).alias("share")).where("share > 0")


@query("SELECT p_partkey, CASE WHEN greatest(p_size / 50.0::DOUBLE, (p_retailprice - 900) / 100) > 0.5 THEN CASE WHEN p_size / 50.0::DOUBLE >= (p_retailprice - 900) / 100 THEN 'size' ELSE 'price' END ELSE 'unknown' END AS label FROM part")
def signal_classify(spark, sf):
    scores = {"size": F.col("p_size") / F.lit(50.0), "price": (F.col("p_retailprice") - 900) / 100}
    return table(spark, sf, "part").select("p_partkey", genomics.first_label(scores).alias("label"))


@query("SELECT p_partkey FROM part WHERE p_retailprice >= 905")
def filter_abundance(spark, sf):
    return table(spark, sf, "part").where("p_retailprice >= 905").select("p_partkey")


@query("SELECT p_partkey, p_name FROM part WHERE p_brand = 'Brand#21' ORDER BY p_partkey LIMIT 1")
def point_lookup(spark, sf):
    return table(spark, sf, "part").where("p_brand = 'Brand#21'").orderBy("p_partkey").limit(1).select("p_partkey", "p_name")


@query("SELECT event_id FROM events WHERE CAST(json_extract(props, '$.k') AS BIGINT) > 0")
def map_filter(spark, sf):
    return table(spark, sf, "events").where(F.from_json("props", "map<string,long>")["k"] > 0).select("event_id")


@query("SELECT o_orderkey FROM orders WHERE o_orderstatus = 'O' AND o_orderdate <= TIMESTAMP '1997-01-01'")
def active_rows(spark, sf):
    return table(spark, sf, "orders").where("o_orderstatus = 'O' and o_orderdate <= timestamp_ntz'1997-01-01'").select("o_orderkey")


@query("SELECT event_id FROM events WHERE value > 400 AND event_id % 100 / 100.0 > 0.75")
def dual_alert(spark, sf):
    return table(spark, sf, "events").where("value > 400 and event_id % 100 / 100.0 > 0.75").select("event_id")


@query("SELECT s_nationkey, bool_and(s_acctbal >= -500) AND count(*) >= 2 AS passes FROM supplier GROUP BY s_nationkey")
def threshold_gate(spark, sf):
    return table(spark, sf, "supplier").groupBy("s_nationkey").agg((F.bool_and(F.col("s_acctbal") >= -500) & (F.count("*") >= 2)).alias("passes"))
