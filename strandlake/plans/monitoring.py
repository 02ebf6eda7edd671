"""Request limits and drift alerts on the tables, with the SQL of each; streams of the same rules are in streaming.limits."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..sources import table
from ..streaming import limits

QUERIES, SQL = {}, {}


def query(sql: str):
    def add(f):
        QUERIES[f.__name__], SQL[f.__name__] = f, sql
        return f

    return add


def requests(spark, sf, key: str):
    at = F.unix_micros(F.col("ts").cast("timestamp"))
    return table(spark, sf, "events").select(F.col(key).alias("key"), at.alias("at"), F.col("event_id").alias("id"), "value")


def ordered(key: str) -> str:
    return f"e AS (SELECT {key} AS key, event_id AS id, epoch_us(ts) AS t, value, row_number() OVER (PARTITION BY {key} ORDER BY ts, event_id) AS i FROM events)"


@query(f"""WITH RECURSIVE {ordered('user_id')}, f AS (
  SELECT DISTINCT key, 0::BIGINT AS i, NULL::BIGINT AS id, NULL::BIGINT AS t, 3.0::DOUBLE AS tokens, 0 AS refused, NULL::BIGINT AS till, NULL::BOOLEAN AS allowed, '' AS why FROM e
  UNION ALL
  SELECT key, i, id, t, CASE WHEN allowed THEN tokens - 1.0 ELSE tokens END, CASE WHEN why = 'rate' AND refused + 1 < 2 THEN refused + 1 WHEN why = 'blocked' THEN refused ELSE 0 END,
    CASE WHEN why = 'rate' AND refused + 1 >= 2 THEN t + 172800000000 WHEN why = 'blocked' THEN till END, allowed, why
  FROM (SELECT *, CASE WHEN coalesce(t < till, false) THEN 'blocked' WHEN tokens >= 1.0 THEN '' ELSE 'rate' END AS why, NOT coalesce(t < till, false) AND tokens >= 1.0 AS allowed
    FROM (SELECT f.key, e.i, e.id, e.t, f.refused, f.till, CASE WHEN f.t IS NULL THEN 3.0::DOUBLE ELSE least(3.0::DOUBLE, f.tokens + (e.t - f.t)::DOUBLE / 1000000.0::DOUBLE * 0.00002::DOUBLE) END AS tokens FROM f JOIN e ON e.key = f.key AND e.i = f.i + 1))
) SELECT key AS user_id, id AS event_id, allowed, why FROM f WHERE i > 0""")
def token_bucket(spark, sf):
    """Two tokens in 28 hours, three at most; two refusals in a row block for two days."""
    rule = limits.token_bucket(rate=0.00002, capacity=3.0, strikes=2, blocked_seconds=172800)
    return limits.folded(requests(spark, sf, "user_id"), rule).select(F.col("key").alias("user_id"), F.col("id").alias("event_id"), "allowed", "why")


@query(f"""WITH RECURSIVE {ordered('user_id')}, f AS (
  SELECT DISTINCT key, 0::BIGINT AS i, NULL::BIGINT AS id, []::BIGINT[] AS times, NULL::BOOLEAN AS allowed FROM e
  UNION ALL
  SELECT key, i, id, CASE WHEN len(times) < 2 THEN list_append(times, t) ELSE times END, len(times) < 2
  FROM (SELECT f.key, e.i, e.id, e.t, list_filter(f.times, lambda x: e.t - x < 86400000000) AS times FROM f JOIN e ON e.key = f.key AND e.i = f.i + 1)
) SELECT key AS user_id, id AS event_id, allowed, len(times)::INT AS counted FROM f WHERE i > 0""")
def accepted_rate(spark, sf):
    """At most two accepted requests of a user within a day; refused ones don't count."""
    return limits.folded(requests(spark, sf, "user_id"), limits.accepted_window(86400, 2)).select(F.col("key").alias("user_id"), F.col("id").alias("event_id"), "allowed", "counted")


#: Of values uniform over 0 to 490, in 490ths.
BASELINE = (0.5, 0.288675, 0.25, 0.5, 0.75)


@query(f"""WITH RECURSIVE {ordered('event_type')}, c AS (
  SELECT key, i AS n, t, abs(avg(value / 490) OVER w - 0.5) / (0.288675 + 1e-8) + (abs(quantile_cont(value / 490, 0.25) OVER w - 0.25) + abs(quantile_cont(value / 490, 0.5) OVER w - 0.5) + abs(quantile_cont(value / 490, 0.75) OVER w - 0.75)) / 3 AS drift
  FROM e WINDOW w AS (PARTITION BY key ORDER BY i ROWS 999 PRECEDING)
), hit AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY n) AS j FROM c WHERE n % 100 = 0 AND drift >= 0.04), f AS (
  SELECT key, n, t, drift, j, t + 518400000000 AS till, true AS sent FROM hit WHERE j = 1
  UNION ALL
  SELECT h.key, h.n, h.t, h.drift, h.j, CASE WHEN h.t < f.till THEN f.till ELSE h.t + 518400000000 END, h.t >= f.till FROM f JOIN hit h ON h.key = f.key AND h.j = f.j + 1
) SELECT key AS event_type, n, round(drift, 6) AS drift, CASE WHEN drift >= 0.75 THEN 'critical' WHEN drift >= 0.5 THEN 'high' WHEN drift >= 0.25 THEN 'medium' WHEN drift >= 0.1 THEN 'low' ELSE 'none' END AS severity FROM f WHERE sent""")
def drift_alerts(spark, sf):
    """The last thousand values of each type, checked at every hundredth; an alert silences its type for six days."""
    events = requests(spark, sf, "event_type").withColumn("value", F.col("value") / 490)
    rule = limits.drift_monitor(BASELINE, threshold=0.04, cooldown_seconds=518400)
    return limits.folded(events, rule).select(F.col("key").alias("event_type"), "n", F.round("drift", 6).alias("drift"), "severity")
