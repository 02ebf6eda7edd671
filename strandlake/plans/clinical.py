"""Calibration and clinical records on the tables, with the SQL of each."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import calibration
from ..sources import fhir_records, fhir_table, table
from .analytic import SCORED, scored

QUERIES, SQL = {}, {}


def query(sql: str | None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


#: Newton's rounds over the distinct scores; they go on to a fixed number, as the fit has stopped moving long before.
PLATT = f"""{SCORED}, g AS (SELECT score AS x, count(*) AS n, sum(label)::DOUBLE AS pos FROM s GROUP BY score), it AS (
  SELECT 0 AS k, 0::DOUBLE AS a, 0::DOUBLE AS b
  UNION ALL
  SELECT k + 1, a + (h11 * g0 - h01 * g1) / (h00 * h11 - h01 * h01), b + (h00 * g1 - h01 * g0) / (h00 * h11 - h01 * h01) FROM (
    SELECT k, a, b, sum(l) - 1e-6 * a AS g0, sum(l * x) - 1e-6 * b AS g1, sum(w) + 1e-6 AS h00, sum(w * x) AS h01, sum(w * x * x) + 1e-6 AS h11 FROM (
      SELECT k, a, b, x, pos - n * p AS l, n * (p * (1 - p) + 1e-12) AS w FROM (SELECT it.*, g.*, 1 / (1 + exp(-(a + b * x))) AS p FROM it, g WHERE k < 25)) GROUP BY k, a, b)
), curve AS (SELECT a, b FROM it WHERE k = 25)"""

#: The best non-decreasing fit at a point: over all starts at or before it, the largest of the least means from there to an end at or after it.
ISOTONIC = """d AS (SELECT row_number() OVER (ORDER BY score) AS i, score AS x, count(*) AS n, sum(label) AS pos FROM s GROUP BY score), c AS (
  SELECT *, sum(n) OVER (ORDER BY i) AS cn, sum(pos) OVER (ORDER BY i) AS cp FROM d
), m AS (SELECT p.i AS a, q.i AS b, (q.cp - p.cp + p.pos)::DOUBLE / (q.cn - p.cn + p.n)::DOUBLE AS mean FROM c p JOIN c q ON p.i <= q.i
), least_from AS (SELECT a, b, min(mean) OVER (PARTITION BY a ORDER BY b DESC) AS least FROM m
), iso AS (SELECT x, n, p FROM (SELECT b, max(least) AS p FROM least_from GROUP BY b) JOIN c ON i = b)"""


@query(f"WITH RECURSIVE {PLATT} SELECT id, round(1 / (1 + exp(-(a + b * score))), 6) AS p FROM s, curve")
def calibrated_platt(spark, sf):
    return calibration.calibrated(scored(spark, sf), "platt").select("id", F.round("p", 6).alias("p"))


@query(f"WITH {SCORED}, {ISOTONIC} SELECT id, round(p, 6) AS p FROM s JOIN iso ON s.score = x")
def calibrated_isotonic(spark, sf):
    return calibration.calibrated(scored(spark, sf), "isotonic").select("id", F.round("p", 6).alias("p"))


@query(f"WITH {SCORED}, {ISOTONIC} SELECT min(x) AS x, sum(n)::BIGINT AS n, round(p, 6) AS p FROM (SELECT x, n, round(p, 12) AS p FROM iso) GROUP BY p")
def isotonic_steps(spark, sf):
    return calibration.isotonic(scored(spark, sf)).select("x", "n", F.round("p", 6).alias("p"))


@query(f"""WITH RECURSIVE {PLATT}, {ISOTONIC}, every AS (
  SELECT 'none' AS method, label, score AS p FROM s UNION ALL SELECT 'platt', label, 1 / (1 + exp(-(a + b * score))) FROM s, curve UNION ALL SELECT 'isotonic', label, p FROM s JOIN iso ON s.score = iso.x
), bins AS (SELECT method, least(greatest(ceil(p * 10) - 1, 0), 9) AS bin, count(*) AS n, abs(avg(label) - avg(p)) AS gap FROM every GROUP BY ALL)
SELECT method, round(avg((least(greatest(p, 1e-12), 1 - 1e-12) - label) ** 2), 5) AS brier, any_value(ece) AS ece, any_value(mce) AS mce
FROM every JOIN (SELECT method, round(sum(n * gap) / sum(n), 5) AS ece, round(max(gap), 5) AS mce FROM bins GROUP BY method) USING (method) GROUP BY method""")
def calibration_by_method(spark, sf):
    return calibration.by_method(scored(spark, sf)).select("method", *(F.round(c, 5).alias(c) for c in ("brier", "ece", "mce")))


def bundles(spark, sf):
    """A bundle of six entries for each order, as JSON: what is said, and what is missing, goes by the order."""
    o = F.col
    coding = lambda system, code, display: F.struct(F.lit(system).alias("system"), code.alias("code"), display.alias("display"))
    coded = lambda *c: F.struct(F.array(*c).alias("coding"))
    at = F.concat(F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss"), F.lit("Z"))
    price = F.struct(o("o_totalprice").alias("value"), F.lit("mg/dL").alias("unit"))
    entry = lambda kind, **parts: F.to_json(F.struct(F.struct(F.lit(kind).alias("resourceType"), *(v.alias(k) for k, v in parts.items())).alias("resource")))
    third = o("o_orderkey") % 3
    entries = F.concat_ws(
        ",",
        entry("Patient", birthDate=F.date_format("o_orderdate", "yyyy-MM-dd"), gender=o("o_orderstatus"), extension=F.array(F.struct(F.lit("x/us-core-race").alias("url"), o("o_orderpriority").alias("valueString")))),
        entry("Observation", id=F.concat(F.lit("m"), o("o_orderkey")), code=F.when(o("o_orderkey") % 7 > 0, coded(coding("http://loinc.org", F.lit("2339-0"), o("o_orderpriority")))), valueQuantity=F.when(third == 0, price), valueString=F.when(third > 0, o("o_orderstatus")), effectiveDateTime=at, referenceRange=F.array(F.struct(F.struct(F.lit(70.5).alias("value")).alias("low")))),
        entry("Condition", id=F.concat(F.lit("d"), o("o_orderkey")), code=coded(coding("http://hl7.org/fhir/sid/ICD-10", F.concat(F.lit("E"), third), F.when(third > 0, o("o_orderstatus"))), coding("http://SNOMED.info/sct", o("o_custkey").cast("string"), F.lit("x"))), clinicalStatus=F.when(third == 1, coded(coding("s", F.lit("active"), F.lit("Active")))), onsetDateTime=at),
        entry("MedicationStatement", id=F.concat(F.lit("t"), o("o_orderkey")), medicationCodeableConcept=coded(coding("http://RxNorm", o("o_custkey").cast("string"), o("o_orderpriority"))), effectivePeriod=F.struct(at.alias("start")), status=F.when(third == 2, "stopped"), dosage=F.array(F.struct(F.when(third == 0, F.lit("one a day")).alias("text"), F.array(F.struct(F.struct(third.alias("value"), F.lit("mg").alias("unit")).alias("doseQuantity"))).alias("doseAndRate")))),
        entry("FamilyMemberHistory", relationship=F.when(third > 0, coded(coding("r", F.lit("MTH"), F.lit("mother")))), condition=F.array(F.struct(coded(coding("c", F.lit("c1"), o("o_orderpriority"))).alias("code"), F.struct((third * 10).alias("value")).alias("onsetAge")), F.struct(coded(coding("c", o("o_orderstatus"), F.lit(None).cast("string"))).alias("code"), F.lit(None).cast("struct<value:bigint>").alias("onsetAge")))),
        F.when(third == 0, entry("Device", id=F.lit("x"))).otherwise(F.lit("{}")),
    )
    text = F.when(o("o_orderkey") % 11 == 0, F.lit("{broken")).otherwise(F.concat(F.lit('{"resourceType":"Bundle","entry":['), entries, F.lit("]}")))
    return table(spark, sf, "orders").select(o("o_orderkey").alias("bundle"), text.alias("text"))


def records(spark, sf):
    return fhir_records(bundles(spark, sf), today=F.lit("2024-06-30").cast("date"))


GOOD = "o AS (SELECT *, o_orderkey % 3 AS third, epoch(o_orderdate)::BIGINT AS secs FROM orders WHERE o_orderkey % 11 <> 0)"


@query(f"WITH {GOOD} SELECT o_orderkey AS bundle, o_orderdate::DATE::VARCHAR AS birth_date, ((DATE '2024-06-30' - o_orderdate::DATE) // 365)::INT AS age, o_orderstatus AS gender, o_orderpriority AS race, NULL::VARCHAR AS ethnicity FROM o")
def fhir_patients(spark, sf):
    return fhir_table(records(spark, sf), "patients").withColumn("birth_date", F.col("birth_date").cast("string")).drop("entry")


@query(f"""WITH {GOOD} SELECT o_orderkey AS bundle, 'm' || o_orderkey AS measurement_id, o_orderpriority AS measurement, CASE WHEN third > 0 THEN o_orderstatus END AS said, CASE WHEN third = 0 THEN o_totalprice END AS number,
 CASE WHEN third = 0 THEN 'mg/dL' END AS unit, secs, 'http://loinc.org' AS code_system, '2339-0' AS code, 70.5::DOUBLE AS low, NULL::DOUBLE AS high, NULL::VARCHAR AS abnormal FROM o WHERE o_orderkey % 7 > 0""")
def fhir_observations(spark, sf):
    said = F.when(F.col("number").isNull(), F.col("value"))
    return fhir_table(records(spark, sf), "observations").withColumn("said", said).withColumn("secs", F.unix_timestamp("at")).drop("entry", "value", "at")


@query(f"""WITH {GOOD} SELECT o_orderkey AS bundle, 'd' || o_orderkey AS diagnosis_id, CASE WHEN third > 0 THEN o_orderstatus ELSE 'E0' END AS name, secs AS onset, CASE WHEN third = 1 THEN 'active' ELSE 'resolved' END AS status,
 'E' || third AS icd10, o_custkey::VARCHAR AS snomed, NULL::VARCHAR AS severity FROM o""")
def fhir_conditions(spark, sf):
    return fhir_table(records(spark, sf), "conditions").withColumn("onset", F.unix_timestamp("onset")).drop("entry")


@query(f"""WITH {GOOD} SELECT o_orderkey AS bundle, 't' || o_orderkey AS medication_id, o_orderpriority AS name, secs AS start, CASE WHEN third = 2 THEN 'stopped' ELSE 'active' END AS status, o_custkey::VARCHAR AS rxnorm,
 CASE WHEN third = 0 THEN 'one a day' ELSE third || ' mg' END AS dose FROM o""")
def fhir_medications(spark, sf):
    return fhir_table(records(spark, sf), "medications").withColumn("start", F.unix_timestamp("start")).drop("entry", "end", "route", "indication")


@query(f"""WITH {GOOD} SELECT o_orderkey AS bundle, 'mother' AS relationship, o_orderpriority AS condition, (third * 10)::DOUBLE AS age_at_onset FROM o WHERE third > 0
UNION ALL SELECT o_orderkey, 'mother', o_orderstatus, NULL FROM o WHERE third > 0""")
def fhir_family(spark, sf):
    return fhir_table(records(spark, sf), "family").select("bundle", "relationship", "condition", "age_at_onset")


@query(f"""WITH {GOOD} SELECT o_orderkey AS bundle, NULL::INT AS entry, 'not json' AS rejected FROM orders WHERE o_orderkey % 11 = 0
UNION ALL SELECT o_orderkey, 1, 'incomplete' FROM o WHERE o_orderkey % 7 = 0 UNION ALL SELECT o_orderkey, 4, 'incomplete' FROM o WHERE third = 0
UNION ALL SELECT o_orderkey, 5, CASE WHEN third = 0 THEN 'other type' ELSE 'no type' END FROM o""")
def fhir_rejected(spark, sf):
    return records(spark, sf).where("rejected is not null").select("bundle", "entry", "rejected")
