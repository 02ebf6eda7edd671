"""Evaluation, signals, vectors, integrity and text."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import vectors as V
from ..operators import evaluation, integrity, signals
from ..operators.redaction import PII
from ..sources import table

QUERIES, SQL = {}, {}


def query(sql: str | None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


SCORED = "s AS (SELECT l.doc_id AS id, l.quality AS label, least(d.n_chars / 5000.0::DOUBLE, 1.0) AS score FROM labels l JOIN documents d USING (doc_id))"


def scored(spark, sf):
    score = F.least(F.col("n_chars") / F.lit(5000.0), F.lit(1.0))
    return table(spark, sf, "labels").join(table(spark, sf, "documents").select("doc_id", "n_chars"), "doc_id").select(F.col("doc_id").alias("id"), F.col("quality").alias("label"), score.alias("score"))


@query(f"WITH {SCORED}, r AS (SELECT label, rank() OVER (ORDER BY score) + (count(*) OVER (PARTITION BY score) - 1) / 2.0 AS r FROM s) SELECT round((sum(r) FILTER (label = 1) - sum(label) * (sum(label) + 1) / 2.0) / (sum(label) * sum(1 - label)), 6) AS auroc FROM r")
def auroc(spark, sf):
    return evaluation.auroc(scored(spark, sf)).select(F.round("auroc", 6).alias("auroc"))


@query(f"WITH {SCORED}, r AS (SELECT label, sum(label) OVER w / count(*) OVER w AS p FROM s WINDOW w AS (ORDER BY score DESC, id ROWS UNBOUNDED PRECEDING)) SELECT round(sum(p) FILTER (label = 1) / sum(label), 6) AS average_precision FROM r")
def average_precision(spark, sf):
    return evaluation.average_precision(scored(spark, sf)).select(F.round("average_precision", 6).alias("average_precision"))


@query(f"WITH {SCORED}, b AS (SELECT least(greatest(ceil(score * 10) - 1, 0), 9) AS b, count(*) AS n, abs(avg(label) - avg(score)) AS g FROM s GROUP BY 1) SELECT round(sum(n * g) / sum(n), 6) AS ece, round(max(g), 6) AS mce FROM b")
def ece_mce(spark, sf):
    return evaluation.calibration(scored(spark, sf)).select(F.round("ece", 6).alias("ece"), F.round("mce", 6).alias("mce"))


@query(f"WITH {SCORED} SELECT count(*) FILTER (score >= 0.5 AND label = 1) AS tp, count(*) FILTER (score >= 0.5 AND label = 0) AS fp, count(*) FILTER (score < 0.5 AND label = 0) AS tn, count(*) FILTER (score < 0.5 AND label = 1) AS fn, round(avg((least(greatest(score, 1e-12), 1 - 1e-12) - label) ** 2), 6) AS brier FROM s")
def confusion(spark, sf):
    return evaluation.confusion(scored(spark, sf)).withColumn("brier", F.round("brier", 6))


@query(f"""WITH {SCORED}, b AS (SELECT score, sum(label) AS p, sum(1 - label) AS n FROM s GROUP BY score),
 j AS (SELECT score, round(sum(p) OVER w / (SELECT sum(p) FROM b) - sum(n) OVER w / (SELECT sum(n) FROM b), 9) AS j FROM b WINDOW w AS (ORDER BY score DESC ROWS UNBOUNDED PRECEDING)) SELECT score AS threshold, j FROM j ORDER BY j DESC, score LIMIT 1""")
def youden_j(spark, sf):
    return evaluation.youden(scored(spark, sf))


SERIES = "e AS (SELECT user_id AS key, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS idx, value FROM events)"


def series(spark, sf):
    events = table(spark, sf, "events")
    return events.select(F.col("user_id").alias("key"), F.row_number().over(W.partitionBy("user_id").orderBy("event_id")).alias("idx"), "value")


@query(f"WITH {SERIES}, m AS (SELECT key, avg(value) AS m, stddev_pop(value) AS sd FROM e GROUP BY key) SELECT key, idx, round((value - m) / sd, 6) AS z FROM e JOIN m USING (key) WHERE sd > 0 AND abs((value - m) / sd) > 2")
def zscore_anomalies(spark, sf):
    return signals.zscores(series(spark, sf)).where("abs(z) > 2").select("key", F.col("idx").cast("long").alias("idx"), F.round("z", 6).alias("z"))


@query(f'WITH {SERIES}, f AS (SELECT key, idx, idx - row_number() OVER (PARTITION BY key ORDER BY idx) AS g FROM e WHERE value > 100) SELECT key, min(idx) AS "start", max(idx) + 1 AS "end", count(*) AS length FROM f GROUP BY key, g HAVING count(*) >= 3')
def anomaly_islands(spark, sf):
    flagged = series(spark, sf).select("key", F.col("idx").cast("long").alias("idx"), (F.col("value") > 100).alias("flag"))
    return signals.islands(flagged, 3)


DRIFT = "round(abs(avg({c}) FILTER (NOT b) - avg({c}) FILTER (b)) / (stddev_pop({c}) FILTER (b) + 1e-8) + abs(ln(stddev_pop({c}) FILTER (NOT b) / (stddev_pop({c}) FILTER (b) + 1e-8))), 6)"


@query("WITH l AS (SELECT *, l_orderkey % 2 = 0 AS b FROM lineitem) " + " UNION ALL ".join(f"SELECT '{c}' AS feature, {DRIFT.format(c=c)} AS drift FROM l" for c in ("l_quantity", "l_discount")))
def covariate_drift(spark, sf):
    lines = table(spark, sf, "lineitem")
    return signals.covariate_drift(lines.where("l_orderkey % 2 = 0"), lines.where("l_orderkey % 2 <> 0"), ["l_quantity", "l_discount"]).withColumn("drift", F.round("drift", 6))


def against_first(spark, sf, distance):
    """(vec_id, distance) of the ten rows nearest to the row of id 0; that one row is what is broadcast."""
    rows = table(spark, sf, "embeddings").select("vec_id", "embedding")
    one = rows.where("vec_id = 0").select(F.col("embedding").alias("q")).limit(1)
    return rows.join(F.broadcast(one)).select("vec_id", F.round(distance(F.col("embedding"), F.col("q")), 5).alias("distance")).orderBy("distance", "vec_id").limit(10)


Q = "q AS (SELECT embedding::DOUBLE[] AS q FROM embeddings WHERE vec_id = 0) SELECT vec_id, round({d}, 5) AS distance FROM embeddings, q ORDER BY distance, vec_id LIMIT 10"


@query("WITH " + Q.format(d="1 - list_cosine_similarity(embedding::DOUBLE[], q)"))
def knn_cosine(spark, sf):
    return against_first(spark, sf, lambda a, b: 1 - V.cosine(a, b))


@query("WITH " + Q.format(d="list_distance(embedding::DOUBLE[], q)"))
def knn_euclidean(spark, sf):
    return against_first(spark, sf, V.euclidean)


@query("WITH " + Q.format(d="list_sum(list_transform(list_zip(embedding, q), lambda x: CASE WHEN (x[1] > 0) <> (x[2] > 0) THEN 1 ELSE 0 END))::DOUBLE"))
def knn_hamming(spark, sf):
    return against_first(spark, sf, lambda a, b: V.hamming(a, b).cast("double"))


@query("SELECT vec_id, pos::INT AS pos, round(v, 6) AS value FROM (SELECT vec_id, unnest(range(64)) AS pos, unnest(list_concat(embedding[63:64], embedding[1:62]))::DOUBLE AS v FROM embeddings)")
def bind_roll(spark, sf):
    return table(spark, sf, "embeddings").select("vec_id", F.posexplode(V.rolled(F.col("embedding"), 2)).alias("pos", "v")).select("vec_id", "pos", F.round(F.col("v").cast("double"), 6).alias("value"))


@query("""WITH a AS (SELECT vec_id, unnest(range(64)) AS j, unnest(embedding)::DOUBLE AS x FROM embeddings WHERE vec_id < 20), b AS (SELECT unnest(range(64)) AS k, unnest(embedding)::DOUBLE AS y FROM embeddings WHERE vec_id = 1)
SELECT vec_id, ((j + k) % 64)::INT AS pos, round(sum(x * y), 6) AS value FROM a, b GROUP BY vec_id, (j + k) % 64""")
def bind_circular(spark, sf):
    rows = table(spark, sf, "embeddings").select("vec_id", "embedding")
    key = rows.where("vec_id = 1").select(F.col("embedding").alias("k"))
    return rows.where("vec_id < 20").join(F.broadcast(key)).select("vec_id", F.posexplode(V.circular(F.col("embedding"), F.col("k"))).alias("pos", "v")).select("vec_id", "pos", F.round("v", 6).alias("value"))  # one key


@query("""WITH a AS (SELECT vec_id, unnest(range(64)) AS j, unnest(embedding)::DOUBLE AS x FROM embeddings), b AS (SELECT unnest(range(64)) AS k, unnest(embedding)::DOUBLE AS y FROM embeddings WHERE vec_id = 1)
SELECT vec_id, ((j + k) % 64)::INT AS pos, round(sum(x * y), 6) AS value FROM a, b GROUP BY vec_id, (j + k) % 64""")
def bind_circular_all(spark, sf):
    """Every vector bound with that of vec_id 1."""
    rows = table(spark, sf, "embeddings").select("vec_id", "embedding")
    key = rows.where("vec_id = 1").select(F.col("embedding").alias("k"))
    return rows.join(F.broadcast(key)).select("vec_id", F.posexplode(V.circular(F.col("embedding"), F.col("k"))).alias("pos", "v")).select("vec_id", "pos", F.round("v", 6).alias("value"))  # one key


@query("""WITH RECURSIVE e AS (SELECT user_id AS ledger, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS idx, event_type AS p FROM events),
c AS (SELECT ledger, idx, sha256('GENESIS|' || p) AS h FROM e WHERE idx = 0 UNION ALL SELECT e.ledger, e.idx, sha256(c.h || '|' || e.p) FROM c JOIN e ON e.ledger = c.ledger AND e.idx = c.idx + 1)
SELECT ledger, arg_max(h, idx) AS head, count(*) AS entries FROM c GROUP BY ledger""")
def ledger_head(spark, sf):
    """The last hash of each user's chain of events."""
    entries = table(spark, sf, "events").select(F.col("user_id").alias("ledger"), (F.row_number().over(W.partitionBy("user_id").orderBy("event_id")) - 1).alias("idx"), F.col("event_type").alias("payload"))
    return integrity.chained(entries).groupBy("ledger").agg(F.max_by("hash", "idx").alias("head"), F.count("*").alias("entries"))


@query("SELECT ledger, count(*) AS entries, count(*) FILTER (idx % 7 = 3) AS broken FROM (SELECT user_id AS ledger, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS idx FROM events) GROUP BY ledger")
def ledger_verify(spark, sf):
    """Chains of events of which every seventh payload was changed after it was hashed."""
    entries = table(spark, sf, "events").select(F.col("user_id").alias("ledger"), (F.row_number().over(W.partitionBy("user_id").orderBy("event_id")) - 1).alias("idx"), F.col("event_type").alias("payload"))
    changed = F.when(F.col("idx") % 7 == 3, F.concat("payload", F.lit("!"))).otherwise(F.col("payload"))
    return integrity.verified(integrity.chained(entries).join(entries.withColumn("payload", changed), ["ledger", "idx"]))


@query("""WITH l AS (SELECT n_nationkey AS i, sha256(n_name) AS h FROM nation), a AS (SELECT i // 2 AS i, sha256(arg_min(h, i) || arg_max(h, i)) AS h FROM l GROUP BY 1), b AS (SELECT i // 2 AS i, sha256(arg_min(h, i) || arg_max(h, i)) AS h FROM a GROUP BY 1),
c AS (SELECT i // 2 AS i, sha256(arg_min(h, i) || arg_max(h, i)) AS h FROM b GROUP BY 1), d AS (SELECT i // 2 AS i, sha256(arg_min(h, i) || arg_max(h, i)) AS h FROM c GROUP BY 1), e AS (SELECT sha256(arg_min(h, i) || arg_max(h, i)) AS h FROM d) SELECT h AS root, 5::INT AS levels FROM e""")
def merkle_root(spark, sf):
    return integrity.merkle_root(table(spark, sf, "nation").select(F.col("n_nationkey").alias("idx"), F.sha2("n_name", 256).alias("hash")))


EMAIL = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}"


@query(f"SELECT doc_id, len(regexp_extract_all(text, '{EMAIL}')) AS n_emails FROM documents WHERE regexp_matches(text, '{EMAIL}')")
def pii_detect(spark, sf):
    return table(spark, sf, "documents").where(F.col("text").rlike(EMAIL)).select("doc_id", F.regexp_count("text", F.lit(EMAIL)).cast("long").alias("n_emails"))


@query(f"SELECT doc_id, md5(regexp_replace(text, '{EMAIL}', '[EMAIL]', 'g')) AS redacted FROM documents WHERE regexp_matches(text, '{EMAIL}')")
def pii_redact(spark, sf):
    return table(spark, sf, "documents").where(F.col("text").rlike(EMAIL)).select("doc_id", F.md5(F.regexp_replace("text", EMAIL, "[EMAIL]").cast("binary")).alias("redacted"))


ANY_PII = "|".join(PII.values())
PII_COUNTS = ", ".join(f"len(regexp_extract_all(text, '{x}')) AS n_{k}" for k, x in PII.items())
PII_REDACTED = "text"
for _kind, _pattern in PII.items():
    PII_REDACTED = f"regexp_replace({PII_REDACTED}, '{_pattern}', '[{_kind.upper()}]', 'g')"


@query(f"SELECT doc_id, {PII_COUNTS} FROM documents WHERE regexp_matches(text, '{ANY_PII}')")
def pii_detect_all(spark, sf):
    """Matches of each kind, which may overlap."""
    counts = [F.regexp_count("text", F.lit(x)).cast("long").alias(f"n_{k}") for k, x in PII.items()]
    return table(spark, sf, "documents").where(F.col("text").rlike(ANY_PII)).select("doc_id", *counts)


@query(f"SELECT doc_id, md5({PII_REDACTED}) AS redacted FROM documents WHERE regexp_matches(text, '{ANY_PII}')")
def pii_redact_all(spark, sf):
    """Each kind replaced in turn, so that an earlier kind takes what two have in common."""
    text = F.col("text")
    for kind, pattern in PII.items():
        text = F.regexp_replace(text, pattern, f"[{kind.upper()}]")
    return table(spark, sf, "documents").where(F.col("text").rlike(ANY_PII)).select("doc_id", F.md5(text.cast("binary")).alias("redacted"))


@query("SELECT doc_id, i - 1 AS line, md5(l) AS line_md5 FROM (SELECT doc_id, unnest(range(1, len(w) + 1)) AS i, unnest(w) AS l FROM (SELECT doc_id, string_split(text, chr(10)) AS w FROM documents)) WHERE contains(lower(l), 'token')")
def phi_scan_lines(spark, sf):
    lines = table(spark, sf, "documents").select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("line", "l"))
    return lines.where(F.lower("l").contains("token")).select("doc_id", F.col("line").cast("long").alias("line"), F.md5(F.col("l").cast("binary")).alias("line_md5"))


@query("SELECT user_id, event_id, round(sum(value / 1000) OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING), 6) AS spent FROM events")
def dp_spent(spark, sf):
    w = W.partitionBy("user_id").orderBy("event_id").rowsBetween(W.unboundedPreceding, 0)
    return table(spark, sf, "events").select("user_id", "event_id", F.round(F.sum(F.col("value") / 1000).over(w), 6).alias("spent"))


@query("SELECT event_id, round(avg(value) OVER (PARTITION BY user_id ORDER BY event_id ROWS 4 PRECEDING), 6) AS rolling, round(value - lag(value) OVER (PARTITION BY user_id ORDER BY event_id), 6) AS step FROM events")
def rolling_monitor(spark, sf):
    w = W.partitionBy("user_id").orderBy("event_id")
    return table(spark, sf, "events").select("event_id", F.round(F.avg("value").over(w.rowsBetween(-4, 0)), 6).alias("rolling"), F.round(F.col("value") - F.lag("value").over(w), 6).alias("step"))


@query("SELECT l_orderkey, count(*) AS n, round(sum(l_extendedprice * (1 - l_discount)), 4) AS revenue FROM lineitem WHERE l_shipdate < TIMESTAMP '1996-01-01' GROUP BY l_orderkey")
def pushed_down(spark, sf):
    return table(spark, sf, "lineitem").where("l_shipdate < timestamp_ntz '1996-01-01 00:00:00'").groupBy("l_orderkey").agg(F.count("*").alias("n"), F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 4).alias("revenue"))
