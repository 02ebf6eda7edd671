"""Rules on records, operations, groups and providers, on the tables, with the SQL of each."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import rules
from ..sources import table

QUERIES, SQL = {}, {}


def query(sql: str):
    def add(f):
        QUERIES[f.__name__], SQL[f.__name__] = f, sql
        return f

    return add


#: Customers as records: which fields they hold, and where the records go.
FIELDS = {
    "name": "c_name",
    "account_number": "CASE WHEN c_acctbal > 5000 THEN c_custkey END",
    "birth_year": "CASE WHEN c_nationkey > 18 THEN 1920 + c_nationkey END",
    "zipcode": "CASE WHEN c_acctbal < 3000 THEN '10' || c_nationkey ELSE '' END",
    "gender": "substr(c_mktsegment, 1, 1)",
    "diagnosis_codes": "CASE WHEN c_nationkey < 9 THEN c_mktsegment END",
    "context": "CASE c_mktsegment WHEN 'AUTOMOBILE' THEN 'transmission' WHEN 'MACHINERY' THEN 'storage' ELSE 'general' END",
    "encrypted": "c_acctbal > 1000",
    "access_controls": "c_nationkey > 12",
}
RECORDS = "r AS (SELECT c_custkey, c_nationkey, " + ", ".join(f"{x} AS {k}" for k, x in FIELDS.items()) + " FROM customer)"


def _records(spark, sf):
    return table(spark, sf, "customer").select("c_custkey", "c_nationkey", *(F.expr(x).alias(k) for k, x in FIELDS.items()))


DIRECT = " UNION ALL ".join(f"SELECT c_custkey, 'direct_identifier' AS kind, '{f}' AS field, '{c}' AS category, 'critical' AS severity, TRUE AS violation FROM r WHERE {f} IS NOT NULL" for f, c in (("name", "direct"), ("account_number", "direct"), ("birth_year", "ages_over_89")))


@query(f"""WITH {RECORDS}, q AS (SELECT c_custkey, list_filter([CASE WHEN zipcode <> '' THEN 'zipcode' END, CASE WHEN birth_year <> 0 THEN 'birth_year' END, CASE WHEN gender <> '' THEN 'gender' END, CASE WHEN diagnosis_codes <> '' THEN 'diagnosis_codes' END], lambda x: x IS NOT NULL) AS held FROM r)
{DIRECT} UNION ALL SELECT c_custkey, 'quasi_identifier_risk', array_to_string(held, ','), NULL, 'medium', FALSE FROM q WHERE len(held) >= 3
UNION ALL SELECT c_custkey, 'encryption_required', NULL, NULL, 'critical', TRUE FROM r WHERE context = 'transmission' AND NOT encrypted
UNION ALL SELECT c_custkey, 'access_controls', NULL, NULL, 'medium', FALSE FROM r WHERE context = 'storage' AND NOT access_controls""")
def hipaa_findings(spark, sf):
    return rules.record_findings(_records(spark, sf), "c_custkey", "context")


#: Events as operations, and what is known of each.
OPERATION = "CASE event_type WHEN 'view' THEN 'data_access' WHEN 'click' THEN 'data_modification' WHEN 'purchase' THEN 'data_transmission' WHEN 'signup' THEN CASE WHEN value < 60 THEN 'data_collection' ELSE 'export_request' END ELSE 'deletion_request' END"
FLAGS = {"unnecessary_fields": "value > 90", "audit_logged": "value < 120", "encrypted": "value > 20", "algorithm_none": "value > 100", "consent_verified": "value > 30", "deletion_blocked": "value > 150", "machine_readable_format": "value < 100"}


@query(f"""WITH e AS (SELECT event_id, {OPERATION} AS operation, {', '.join(f"{x} AS {k}" for k, x in FLAGS.items())} FROM events),
rules(regime, place, operation, flag, must_be, violation) AS (VALUES {', '.join(map(str, rules.OPERATION_RULES))}),
f AS (UNPIVOT e ON {', '.join(FLAGS)} INTO NAME flag VALUE is_set)
SELECT event_id, regime, arg_min(violation, place) AS violation FROM f JOIN rules USING (operation, flag) WHERE is_set <> must_be GROUP BY event_id, regime""")
def operation_violations(spark, sf):
    """The first rule of each regime that an event breaks; rules are a table."""
    flags = F.create_map(*(x for k, e in FLAGS.items() for x in (F.lit(k), F.expr(e))))
    operations = table(spark, sf, "events").select("event_id", F.expr(OPERATION).alias("operation"), flags.alias("flags"))
    return rules.broken_rules(operations, spark.createDataFrame(rules.OPERATION_RULES, rules.RULES_SCHEMA), "event_id")


@query(f"WITH {RECORDS}, g AS (SELECT c_nationkey, count(*) AS n, bool_or(coalesce(zipcode <> '', FALSE) OR birth_year IS NOT NULL) AS demographic FROM r GROUP BY c_nationkey) SELECT c_nationkey, n, demographic, demographic AND n < 50 AS at_risk FROM g")
def small_cohorts(spark, sf):
    """Nations of fewer than fifty customers, of whom some have a place or a year of birth."""
    return rules.small_cohorts(_records(spark, sf), "c_nationkey", 50, ("zipcode", "birth_year"))


@query("""WITH c AS (SELECT s_suppkey, lpad(s_suppkey::VARCHAR, CASE WHEN s_nationkey < 5 THEN 9 ELSE 10 END, '0') AS npi, CASE WHEN s_acctbal < 0 THEN md5(s_name) ELSE sha256(s_name) END AS baa, sha256(s_suppkey::VARCHAR) AS risk, CASE WHEN s_acctbal > 8000 THEN '' ELSE s_name END AS hsm FROM supplier)
SELECT s_suppkey, concat_ws(',', CASE WHEN NOT regexp_full_match(npi, '[0-9]{10}') THEN 'npi' END, CASE WHEN length(baa) <> 64 THEN 'baa_hash' END, CASE WHEN length(risk) <> 64 THEN 'risk_analysis_hash' END, CASE WHEN hsm = '' THEN 'hsm_serial' END) AS errors FROM c""")
def credential_errors(spark, sf):
    npi = F.lpad(F.col("s_suppkey").cast("string"), F.when(F.col("s_nationkey") < 5, 9).otherwise(10), F.lit("0"))
    name = F.col("s_name").cast("binary")
    baa = F.when(F.col("s_acctbal") < 0, F.md5(name)).otherwise(F.sha2(name, 256))
    wrong = rules.credential_errors(npi, baa, F.sha2(F.col("s_suppkey").cast("string").cast("binary"), 256), F.when(F.col("s_acctbal") > 8000, "").otherwise(F.col("s_name")))
    return table(spark, sf, "supplier").select("s_suppkey", F.array_join(wrong, ",").alias("errors"))
