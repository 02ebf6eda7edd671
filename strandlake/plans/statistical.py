"""Statistics, evaluation, drift and federated rounds on the tables, with the SQL of each."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import vectors as V
from ..operators import evaluation, federated, integrity, sequences, signals, statistics
from ..sources import table
from .analytic import SCORED, scored
from .tabular import POSITIONS, updates

QUERIES, SQL = {}, {}


def query(sql: str):
    def add(f):
        QUERIES[f.__name__], SQL[f.__name__] = f, sql
        return f

    return add


@query("""WITH t AS (SELECT l_suppkey, l_returnflag, round(avg(l_discount) / (0.01 + max(l_tax)), 6) AS p FROM lineitem GROUP BY ALL), r AS (SELECT *, p * count(*) OVER (PARTITION BY l_returnflag) / rank() OVER (PARTITION BY l_returnflag ORDER BY p) AS raw FROM t)
SELECT l_suppkey, l_returnflag, round(least(1, min(raw) OVER (PARTITION BY l_returnflag ORDER BY p DESC RANGE UNBOUNDED PRECEDING)), 6) AS fdr FROM r""")
def bh_fdr(spark, sf):
    tests = table(spark, sf, "lineitem").groupBy("l_suppkey", "l_returnflag").agg(F.round(F.avg("l_discount") / (0.01 + F.max("l_tax")), 6).alias("p"))
    return statistics.benjamini_hochberg(tests, ["l_returnflag"]).select("l_suppkey", "l_returnflag", F.round("fdr", 6).alias("fdr"))


TPM = ["l_quantity", "l_discount", "l_tax"]


@query("""WITH t AS (SELECT l_orderkey, l_linenumber, l_quantity + l_discount + l_tax AS s, l_quantity, l_discount, l_tax FROM lineitem), x AS (SELECT l_orderkey, l_linenumber, log2(l_quantity * 1e6 / s + 1) AS q, log2(l_discount * 1e6 / s + 1) AS d, log2(l_tax * 1e6 / s + 1) AS t FROM t)
SELECT l_orderkey, l_linenumber, round((q - avg(q) OVER ()) / (stddev_pop(q) OVER () + 1e-9), 4) AS l_quantity, round((d - avg(d) OVER ()) / (stddev_pop(d) OVER () + 1e-9), 4) AS l_discount, round((t - avg(t) OVER ()) / (stddev_pop(t) OVER () + 1e-9), 4) AS l_tax FROM x""")
def tpm_zscore(spark, sf):
    key = ["l_orderkey", "l_linenumber"]
    z = statistics.column_z(statistics.scaled_rows(table(spark, sf, "lineitem"), key, TPM), key, TPM)
    return z.select(*key, *(F.round(c, 4).alias(c) for c in TPM))


@query("SELECT p_partkey, round(p_retailprice / sum(p_retailprice) OVER () * 1e9, 2) AS share FROM part")
def normalize_total(spark, sf):
    part = table(spark, sf, "part")
    whole = part.agg(F.sum("p_retailprice").alias("s"))  # one row
    return part.join(F.broadcast(whole)).select("p_partkey", F.round(F.col("p_retailprice") / F.col("s") * 1e9, 2).alias("share"))


@query("SELECT p_partkey, round(pow(2, log2(p_retailprice + 1) - (SELECT median(log2(p_retailprice + 1)) FROM part) + 20), 1) AS value FROM part")
def normalize_median(spark, sf):
    part = table(spark, sf, "part").select("p_partkey", F.log2(F.col("p_retailprice") + 1).alias("x"))
    middle = part.agg(F.median("x").alias("m"))  # one row
    return part.join(F.broadcast(middle)).select("p_partkey", F.round(F.pow(F.lit(2.0), F.col("x") - F.col("m") + 20), 1).alias("value"))


@query("SELECT vec_id, (pos - 1)::INT AS pos, round((x - m) / (d + 1e-8), 4) AS z FROM (SELECT vec_id, unnest(range(1, 65)) AS pos, unnest(embedding)::DOUBLE AS x, list_avg(embedding::DOUBLE[]) AS m, list_stddev_pop(embedding::DOUBLE[]) AS d FROM embeddings)")
def row_zscore(spark, sf):
    v = F.col("embedding")
    mean = V.total(v) / F.size(v)
    sd = F.sqrt(V.dot(v, v) / F.size(v) - mean * mean)
    cells = table(spark, sf, "embeddings").select("vec_id", mean.alias("m"), sd.alias("d"), F.posexplode(v).alias("pos", "x"))
    return cells.select("vec_id", "pos", F.round((F.col("x").cast("double") - F.col("m")) / (F.col("d") + 1e-8), 4).alias("z"))


@query("SELECT event_type, round(corr(value, user_id), 6) AS r, round(covar_pop(value, user_id) * count(*), 2) AS cov, round(regr_slope(value, user_id), 6) AS slope FROM events GROUP BY event_type")
def corr_assoc(spark, sf):
    return table(spark, sf, "events").groupBy("event_type").agg(F.round(F.corr("value", "user_id"), 6).alias("r"), F.round(F.covar_pop("value", "user_id") * F.count("*"), 2).alias("cov"), F.round(F.regr_slope("value", "user_id"), 6).alias("slope"))


@query(f"WITH {SCORED} SELECT round(avg(pow(least(greatest(score, 1e-12), 1 - 1e-12) - label, 2)), 6) AS brier FROM s")
def brier(spark, sf):
    return evaluation.confusion(scored(spark, sf)).select(F.round("brier", 6).alias("brier"))


CLIPPED = "least(greatest(score, 1e-12), 1 - 1e-12)"


@query(f"WITH {SCORED} SELECT round(avg(-CASE WHEN label = 1 THEN ln({CLIPPED}) ELSE ln(1 - {CLIPPED}) END), 5) AS logloss, round(avg(((score >= 0.5)::INT = label)::INT), 6) AS accuracy FROM s")
def logloss(spark, sf):
    return evaluation.log_loss(scored(spark, sf)).select(F.round("logloss", 5).alias("logloss"), F.round("accuracy", 6).alias("accuracy"))


@query(f"""WITH {SCORED}, c AS (SELECT count(*) FILTER (score >= 0.5 AND label = 1) AS tp, count(*) FILTER (score >= 0.5 AND label = 0) AS fp, count(*) FILTER (score < 0.5 AND label = 0) AS tn, count(*) FILTER (score < 0.5 AND label = 1) AS fn, avg(pow({CLIPPED} - label, 2)) AS b FROM s)
SELECT round(tp / greatest(1, tp + fn), 6) AS sensitivity, round(tn / greatest(1, tn + fp), 6) AS specificity, round(tp / greatest(1, tp + fp), 6) AS precision, round(2 * tp / (2 * tp + fp + fn), 6) AS f1, round(b, 6) AS brier FROM c""")
def eval_report(spark, sf):
    out = evaluation.rates(scored(spark, sf))
    return out.select(*(F.round(c, 6).alias(c) for c in out.columns))


def _prices(spark, sf, year):
    return table(spark, sf, "orders").where(F.year("o_orderdate") == year).select("o_totalprice")


@query("""WITH s AS (SELECT avg(o_totalprice) FILTER (year(o_orderdate) = 1995) AS m0, stddev_pop(o_totalprice) FILTER (year(o_orderdate) = 1995) AS d0, avg(o_totalprice) FILTER (year(o_orderdate) = 1996) AS m1, quantile_cont(o_totalprice, [0.25, 0.5, 0.75]) FILTER (year(o_orderdate) = 1995) AS q0, quantile_cont(o_totalprice, [0.25, 0.5, 0.75]) FILTER (year(o_orderdate) = 1996) AS q1 FROM orders)
SELECT round(abs(m1 - m0) / (d0 + 1e-8), 6) AS shift, round((abs(q0[1] - q1[1]) + abs(q0[2] - q1[2]) + abs(q0[3] - q1[3])) / 3, 3) AS quartiles FROM s""")
def prediction_drift(spark, sf):
    return statistics.prediction_drift(_prices(spark, sf, 1995), _prices(spark, sf, 1996), "o_totalprice").select(F.round("shift", 6).alias("shift"), F.round("quartiles", 3).alias("quartiles"))


@query("""WITH r AS (SELECT user_id, round_even(value / 100, 0) = round_even((event_id % 500) / 100.0, 0) AS hit, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS r FROM events)
SELECT user_id, round((0.9::DOUBLE - avg(hit::INT)) / 0.9, 6) AS drop, count(*) AS n FROM r WHERE r <= 100 GROUP BY user_id HAVING count(*) >= 10""")
def performance_drift(spark, sf):
    """How far the share of right predictions among each user's last hundred fell below 0.9."""
    hit = (F.bround(F.col("value") / 100) == F.bround((F.col("event_id") % 500) / 100.0)).cast("int")
    last = table(spark, sf, "events").select("user_id", hit.alias("hit"), F.row_number().over(W.partitionBy("user_id").orderBy(F.desc("event_id"))).alias("r")).where("r <= 100")
    return last.groupBy("user_id").agg(F.round((0.9 - F.avg("hit")) / 0.9, 6).alias("drop"), F.count("*").alias("n")).where("n >= 10")


@query("SELECT vec_id, round(d, 5) AS drift, CASE WHEN d >= 0.75 THEN 'critical' WHEN d >= 0.5 THEN 'high' WHEN d >= 0.25 THEN 'medium' WHEN d >= 0.1 THEN 'low' ELSE 'none' END AS severity FROM (SELECT vec_id, 1 - list_cosine_similarity(embedding::DOUBLE[], first_value(embedding) OVER (PARTITION BY label ORDER BY vec_id)::DOUBLE[]) AS d FROM embeddings)")
def semantic_drift(spark, sf):
    """Against the first vector of the label."""
    d = 1 - V.cosine(F.col("embedding"), F.col("b"))
    return sequences.beside_first(table(spark, sf, "embeddings").select("vec_id", "label", "embedding"), "label", "vec_id", "embedding", "b").select("vec_id", F.round(d, 5).alias("drift"), statistics.severity(d).alias("severity"))


@query("SELECT event_type, count(*) AS n, max(event_id) AS last, round(avg(value), 5) AS mean, count(*) FILTER (value >= 300) AS high FROM events GROUP BY event_type")
def drift_stats(spark, sf):
    return table(spark, sf, "events").groupBy("event_type").agg(F.count("*").alias("n"), F.max("event_id").alias("last"), F.round(F.avg("value"), 5).alias("mean"), F.count_if(F.col("value") >= 300).alias("high"))


@query("""WITH c AS (SELECT user_id AS key, event_id AS idx, abs(value - lag(value) OVER (PARTITION BY user_id ORDER BY event_id)) AS change FROM events), r AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY change DESC, idx) AS r FROM c WHERE change IS NOT NULL)
SELECT key, idx, round(change, 4) AS change FROM r WHERE r <= 3""")
def phase_points(spark, sf):
    series = table(spark, sf, "events").select(F.col("user_id").alias("key"), F.col("event_id").alias("idx"), "value")
    return statistics.top_change(series, 3).withColumn("change", F.round("change", 4))


@query("""WITH s AS (SELECT label, vec_id, embedding::DOUBLE[] AS e, lag(embedding) OVER (PARTITION BY label ORDER BY vec_id)::DOUBLE[] AS p FROM embeddings)
SELECT label, count(*) AS steps, round(sum(list_distance(e, p)), 4) AS path FROM s WHERE p IS NOT NULL GROUP BY label""")
def trajectory(spark, sf):
    steps = sequences.beside_previous(table(spark, sf, "embeddings").select("vec_id", "label", "embedding"), "label", "vec_id", "embedding", "p").where("p is not null")
    return steps.groupBy("label").agg(F.count("*").alias("steps"), F.round(F.sum(V.euclidean(F.col("embedding"), F.col("p"))), 4).alias("path"))


@query("SELECT user_id, count(*) AS n, round(avg(value), 5) AS mean, round(stddev_pop(value), 5) AS sd, max(value) AS top, round(skewness(value), 3) AS skew FROM events GROUP BY user_id HAVING count(*) > 3")
def region_features(spark, sf):
    n = F.count("*")
    # the sample's skewness, from the population's
    skew = F.skewness("value") * F.sqrt(n * (n - 1)) / (n - 2)
    return table(spark, sf, "events").groupBy("user_id").agg(n.alias("n"), F.round(F.avg("value"), 5).alias("mean"), F.round(F.stddev_pop("value"), 5).alias("sd"), F.max("value").alias("top"), F.round(skew, 3).alias("skew")).where("n > 3")


@query("""WITH RECURSIVE s AS (SELECT user_id AS key, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS r, value / 100 AS e FROM events), f AS (
SELECT key, r, CASE WHEN e <= 20 + 1e-9 THEN 1 ELSE 0 END AS accepted, CASE WHEN e <= 20 + 1e-9 THEN e ELSE 0 END AS spent FROM s WHERE r = 1
UNION ALL SELECT s.key, s.r, accepted + CASE WHEN spent + e <= 20 + 1e-9 THEN 1 ELSE 0 END, CASE WHEN spent + e <= 20 + 1e-9 THEN spent + e ELSE spent END FROM f JOIN s ON s.key = f.key AND s.r = f.r + 1)
SELECT key, arg_max(accepted, r)::INT AS accepted, round(arg_max(spent, r), 6) AS spent FROM f GROUP BY key""")
def dp_budget_fold(spark, sf):
    spends = table(spark, sf, "events").select(F.col("user_id").alias("key"), F.col("event_id").alias("idx"), (F.col("value") / 100).alias("epsilon"))
    return statistics.budget_fold(spends, 20.0).withColumn("spent", F.round("spent", 6))


@query("SELECT user_id, round(coalesce(sum(value) FILTER (ts > TIMESTAMP '2024-01-29'), 0), 4) AS day, round(coalesce(sum(value) FILTER (ts > TIMESTAMP '2024-01-23'), 0), 4) AS week, round(sum(value), 4) AS month FROM events GROUP BY user_id")
def period_consumption(spark, sf):
    since = lambda day: F.round(F.coalesce(F.sum(F.when(F.col("ts") > F.expr(f"timestamp_ntz'{day}'"), F.col("value"))), F.lit(0.0)), 4)
    return table(spark, sf, "events").groupBy("user_id").agg(since("2024-01-29").alias("day"), since("2024-01-23").alias("week"), F.round(F.sum("value"), 4).alias("month"))


@query("""WITH RECURSIVE s AS (SELECT event_type AS key, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) AS r, (epoch_us(ts) // 1000000) AS t FROM events WHERE value > 300), f AS (SELECT key, r, 1 AS n, t AS last FROM s WHERE r = 1
UNION ALL SELECT s.key, s.r, n + CASE WHEN t - last >= 36000 THEN 1 ELSE 0 END, CASE WHEN t - last >= 36000 THEN t ELSE last END FROM f JOIN s ON s.key = f.key AND s.r = f.r + 1) SELECT key, max(n)::INT AS emitted FROM f GROUP BY key""")
def alert_cooldown(spark, sf):
    alerts = table(spark, sf, "events").where("value > 300").select(F.col("event_type").alias("key"), F.unix_timestamp(F.col("ts").cast("timestamp")).alias("at"))
    return statistics.cooled(alerts, 36000)


@query("SELECT event_id, count(*) OVER (PARTITION BY user_id ORDER BY (epoch_us(ts) // 1000000) RANGE BETWEEN 86399 PRECEDING AND CURRENT ROW) AS n FROM events")
def request_rate(spark, sf):
    w = W.partitionBy("user_id").orderBy("at").rangeBetween(-86399, 0)
    return table(spark, sf, "events").select("event_id", "user_id", F.unix_timestamp(F.col("ts").cast("timestamp")).alias("at")).select("event_id", F.count("*").over(w).alias("n"))


@query("""SELECT user_id, count(*) AS n, round(avg(d), 3) AS mean_gap, max(d) AS max_gap, count(DISTINCT event_type) AS types, round(avg((event_type <> 'error')::INT), 6) AS success FROM (SELECT *, (epoch_us(ts) // 1000000) - lag((epoch_us(ts) // 1000000)) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS d FROM events) GROUP BY user_id""")
def access_features(spark, sf):
    at = F.unix_timestamp(F.col("ts").cast("timestamp"))
    gaps = table(spark, sf, "events").withColumn("d", at - F.lag(at).over(W.partitionBy("user_id").orderBy("ts", "event_id")))
    return gaps.groupBy("user_id").agg(F.count("*").alias("n"), F.round(F.avg("d"), 3).alias("mean_gap"), F.max("d").alias("max_gap"), F.count_distinct("event_type").alias("types"), F.round(F.avg((F.col("event_type") != "error").cast("int")), 6).alias("success"))


@query(f"WITH {POSITIONS} SELECT pos::INT AS pos, round(avg(w), 6) AS value FROM p GROUP BY pos")
def fedavg_mean(spark, sf):
    one = updates(spark, sf).withColumn("n", F.lit(1))
    return federated.weighted_mean(one).withColumn("value", F.round("value", 6))


@query("SELECT round(sum(coalesce(CAST(json_extract(props, '$.k') AS BIGINT), 0)) / count(*), 6) AS k, count(*) AS clients FROM events")
def client_means(spark, sf):
    """A client without the key counts as 0."""
    return table(spark, sf, "events").agg(F.round(F.sum(F.coalesce(F.get_json_object("props", "$.k").cast("long"), F.lit(0))) / F.count("*"), 6).alias("k"), F.count("*").alias("clients"))


@query("SELECT label, count(*) AS clients, sum(label + 1)::BIGINT AS samples, round(avg(embedding[1]::DOUBLE), 6) AS loss, round(count(*) / (SELECT count(*) FROM embeddings), 6) AS participation FROM embeddings GROUP BY label")
def round_metrics(spark, sf):
    rows = table(spark, sf, "embeddings")
    whole = rows.agg(F.count("*").alias("all"))  # one row
    by = rows.groupBy("label").agg(F.count("*").alias("clients"), F.sum(F.col("label") + 1).cast("long").alias("samples"), F.round(F.avg(F.get("embedding", F.lit(0)).cast("double")), 6).alias("loss"))
    return by.join(F.broadcast(whole)).select("label", "clients", "samples", "loss", F.round(F.col("clients") / F.col("all"), 6).alias("participation"))


@query(f"WITH {POSITIONS} SELECT pos::INT AS pos, round(sum(w), 5) AS value FROM p GROUP BY pos")
def secure_sum(spark, sf):
    """What the masks of rings of clients leave is the plain sum."""
    return federated.masked_sums(updates(spark, sf), bucket=100).withColumn("value", F.round("value", 5))


@query(f"WITH {POSITIONS}, m AS (SELECT pos, avg(w) AS m FROM p GROUP BY pos) SELECT vec_id AS client, CASE WHEN sqrt(sum(pow(w - m, 2))) < 1 THEN 0.81 ELSE 0.75 END::DOUBLE AS reputation FROM p JOIN m USING (pos) GROUP BY vec_id")
def reputation(spark, sf):
    return federated.reputation(updates(spark, sf), start=0.8, near=1.0)


@query(f"WITH {POSITIONS}, s AS (SELECT vec_id, sqrt(sum(w * w)) AS l FROM p GROUP BY vec_id) SELECT vec_id AS client, pos::INT AS pos, round(w * least(1, 0.5 / l), 6) AS w FROM p JOIN s USING (vec_id)")
def clip_l2(spark, sf):
    clipped = federated.clipped(updates(spark, sf), 0.5)
    return federated.positions(clipped).select("client", "pos", F.round("w", 6).alias("w"))


@query(f"WITH {POSITIONS} SELECT pos::INT AS pos, sign(sum(w))::INT AS value FROM p GROUP BY pos")
def bundle_signum(spark, sf):
    return federated.bundle(updates(spark, sf), "signum")


@query(f"WITH {POSITIONS} SELECT pos::INT AS pos, round(avg(w), 5) AS mean, round(var_pop(w), 5) AS variance FROM p GROUP BY pos HAVING avg(w) > 0.001")
def maf_filter(spark, sf):
    return federated.positions(updates(spark, sf)).groupBy("pos").agg(F.avg("w").alias("m"), F.round(F.var_pop("w"), 5).alias("variance")).where("m > 0.001").select("pos", F.round("m", 5).alias("mean"), "variance")


@query(f"WITH {POSITIONS} SELECT pos::INT AS pos, round(avg((w > 0)::INT), 6) AS rate FROM p GROUP BY pos HAVING avg((w > 0)::INT) BETWEEN 0.48 AND 0.99")
def carrier_filter(spark, sf):
    by = federated.positions(updates(spark, sf)).groupBy("pos").agg(F.avg((F.col("w") > 0).cast("int")).alias("rate"))
    return by.where("rate between 0.48 and 0.99").withColumn("rate", F.round("rate", 6))


@query("SELECT o_orderpriority, round(avg(o_totalprice), 3) AS mean, round(stddev_pop(o_totalprice), 3) AS sd FROM orders GROUP BY o_orderpriority")
def mean_std(spark, sf):
    return table(spark, sf, "orders").groupBy("o_orderpriority").agg(F.round(F.avg("o_totalprice"), 3).alias("mean"), F.round(F.stddev_pop("o_totalprice"), 3).alias("sd"))


@query("SELECT round(avg(turn), 6) AS repeats, round(avg(len(text)), 4) AS error, round(avg((role = 'user')::INT), 6) AS success FROM conversations")
def batch_stats(spark, sf):
    return table(spark, sf, "conversations").agg(F.round(F.avg("turn"), 6).alias("repeats"), F.round(F.avg(F.length("text")), 4).alias("error"), F.round(F.avg((F.col("role") == "user").cast("int")), 6).alias("success"))


@query("SELECT p_brand, median(p_retailprice) AS median_value, round(avg(p_retailprice), 4) AS mean, count(*) FILTER (p_retailprice > 950) AS high, round(log10(max(p_retailprice) / min(p_retailprice)), 6) AS spread FROM part GROUP BY p_brand")
def quality_metrics(spark, sf):
    p = F.col("p_retailprice")
    return table(spark, sf, "part").groupBy("p_brand").agg(F.median(p).alias("median_value"), F.round(F.avg(p), 4).alias("mean"), F.count_if(p > 950).alias("high"), F.round(F.log10(F.max(p) / F.min(p)), 6).alias("spread"))


@query("SELECT p_type AS metric, round(avg(p_retailprice), 4) AS mean, min(p_retailprice) AS low, max(p_retailprice) AS high, round(stddev_pop(p_retailprice), 4) AS sd FROM part GROUP BY p_type")
def metric_claims(spark, sf):
    p = F.col("p_retailprice")
    return table(spark, sf, "part").groupBy(F.col("p_type").alias("metric")).agg(F.round(F.avg(p), 4).alias("mean"), F.min(p).alias("low"), F.max(p).alias("high"), F.round(F.stddev_pop(p), 4).alias("sd"))


@query("SELECT sum(CASE WHEN s_suppkey % 10 IN (1, 4, 8) THEN s_suppkey % 10 ELSE 1 END + CASE WHEN s_nationkey % 3 = 0 THEN 10 ELSE 0 END)::BIGINT AS power FROM supplier")
def voting_power(spark, sf):
    kind = F.col("s_suppkey") % 10
    return table(spark, sf, "supplier").agg(F.sum(F.when(kind.isin(1, 4, 8), kind).otherwise(1) + F.when(F.col("s_nationkey") % 3 == 0, 10).otherwise(0)).alias("power"))


@query("""WITH s AS (SELECT user_id, value, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS r FROM events) SELECT user_id, round(regr_slope(value, r), 6) AS slope, CASE WHEN regr_slope(value, r) > 1 THEN 'increasing' WHEN regr_slope(value, r) < -1 THEN 'decreasing' ELSE 'stable' END AS trend
FROM (SELECT e.user_id, e.value, row_number() OVER (PARTITION BY e.user_id ORDER BY e.event_id) AS r FROM events e WHERE ts >= TIMESTAMP '2024-01-23') GROUP BY user_id""")
def recent_week_trend(spark, sf):
    """The slope of the last seven days' values against their order, by user."""
    last = table(spark, sf, "events").where("ts >= timestamp_ntz'2024-01-23'").select("user_id", "value", F.row_number().over(W.partitionBy("user_id").orderBy("event_id")).alias("r"))
    slope = F.regr_slope("value", "r")
    return last.groupBy("user_id").agg(F.round(slope, 6).alias("slope"), F.when(slope > 1, "increasing").when(slope < -1, "decreasing").otherwise("stable").alias("trend"))


@query("""WITH z AS (SELECT user_id AS key, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS idx, value FROM events), f AS (SELECT key, idx, abs(value - m) / sd > 0.8 AS flag FROM z JOIN (SELECT user_id AS key, avg(value) AS m, stddev_pop(value) AS sd FROM events GROUP BY 1) USING (key)),
r AS (SELECT key, idx, idx - row_number() OVER (PARTITION BY key ORDER BY idx) AS run FROM f WHERE flag) SELECT key, min(idx) AS start, max(idx) + 1 AS "end", count(*) AS length FROM r GROUP BY key, run HAVING count(*) >= 5""")
def anomaly_regions(spark, sf):
    """Runs of five or more values of a user that are 0.8 deviations or more from the mean."""
    series = table(spark, sf, "events").select(F.col("user_id").alias("key"), F.row_number().over(W.partitionBy("user_id").orderBy("event_id")).cast("long").alias("idx"), "value")
    flagged = signals.zscores(series).select("key", "idx", (F.abs("z") > 0.8).alias("flag"))
    return signals.islands(flagged, 5)


def _leaves(spark, sf):
    return table(spark, sf, "nation").select(F.col("n_nationkey").cast("long").alias("idx"), F.sha2("n_name", 256).alias("hash"))


@query("""WITH a0 AS (SELECT n_nationkey AS i, sha256(n_name) AS h FROM nation), a1 AS (SELECT i // 2 AS i, sha256(unhex('00000004') || 'NODE'::BLOB || unhex('00000020') || unhex(arg_min(h, i)) || unhex('00000020') || unhex(arg_max(h, i))) AS h FROM a0 GROUP BY 1) SELECT i::BIGINT AS idx, h AS hash FROM a1""")
def merkle_level(spark, sf):
    """The first level above the leaves, of tagged parts with their lengths in front."""
    return integrity.merkle_levels(_leaves(spark, sf))[1]


@query("""WITH a0 AS (SELECT n_nationkey AS i, sha256(n_name) AS h FROM nation), a1 AS (SELECT i // 2 AS i, sha256(unhex('00000004') || 'NODE'::BLOB || unhex('00000020') || unhex(arg_min(h, i)) || unhex('00000020') || unhex(arg_max(h, i))) AS h FROM a0 GROUP BY 1)
SELECT 0 AS level, i::BIGINT AS idx, h AS hash FROM a0 WHERE i = 6 UNION ALL SELECT 1, i, h FROM a1 WHERE i = 2""")
def proof_siblings(spark, sf):
    """The first two siblings on the path of leaf 7."""
    return integrity.merkle_path(_leaves(spark, sf), 7).where("level < 2")
