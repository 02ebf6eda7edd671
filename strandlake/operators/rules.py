"""Rules on records of health data and on what is done with them: findings by record, by operation, by group and by provider."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Fields that identify a person, by category, and those that do so together.
IDENTIFIERS = {
    "direct": ("name", "ssn", "mrn", "address", "phone", "email", "fax", "account_number", "certificate_number", "vehicle_id", "device_id", "url", "ip_address", "biometric_id", "photo"),
    "dates": ("birth_date", "admission_date", "discharge_date", "death_date", "treatment_date", "service_date"),
    "ages_over_89": ("age", "birth_year", "age_at_diagnosis", "age_at_treatment"),
}
QUASI = ("zipcode", "birth_year", "gender", "ethnicity", "diagnosis_codes")
DEMOGRAPHIC = ("zipcode", "birth_year", "gender")
#: What the two health-data and personal-data regimes ask of an operation: (regime, place, operation, flag, must_be, violation).
OPERATION_RULES = [
    ("hipaa", 1, "data_access", "unnecessary_fields", False, "hipaa_minimum_necessary"),
    *(("hipaa", 2, x, "audit_logged", True, "hipaa_audit_trail_missing") for x in ("data_access", "data_modification", "data_deletion")),
    ("hipaa", 3, "data_transmission", "encrypted", True, "hipaa_encryption_missing"),
    ("hipaa", 4, "data_transmission", "algorithm_none", False, "hipaa_encryption_missing"),
    *(("gdpr", 1, x, "consent_verified", True, "gdpr_consent_missing") for x in ("data_collection", "data_processing")),
    ("gdpr", 2, "deletion_request", "deletion_blocked", False, "gdpr_right_to_erasure_blocked"),
    ("gdpr", 3, "export_request", "machine_readable_format", True, "gdpr_portability_format"),
]
RULES_SCHEMA = "regime string, place int, operation string, flag string, must_be boolean, violation string"


def filled(df: DataFrame, field: str) -> Column:
    """Whether a field holds anything: for text, anything but white space; for other types, anything but null. False for a field that df lacks."""
    if field not in df.columns:
        return F.lit(False)
    x = F.col(f"`{field}`")
    return F.coalesce(x.rlike(r"\S") if isinstance(df.schema[field].dataType, T.StringType) else x.isNotNull(), F.lit(False))


def truthy(df: DataFrame, field: str) -> Column:
    """Whether a field is there and not empty, zero or false. False for a field that df lacks."""
    if field not in df.columns:
        return F.lit(False)
    x, kind = F.col(f"`{field}`"), df.schema[field].dataType
    if isinstance(kind, T.StringType):
        known = x != ""
    elif isinstance(kind, (T.ArrayType, T.MapType)):
        known = F.size(x) > 0
    elif isinstance(kind, T.BooleanType):
        known = x
    elif isinstance(kind, T.NumericType):
        known = x != 0
    else:
        known = x.isNotNull()
    return F.coalesce(known, F.lit(False))


def record_findings(records: DataFrame, key: str, context: str | None = None, identifiers: Mapping[str, Sequence[str]] = IDENTIFIERS, quasi: Sequence[str] = QUASI, together: int = 3) -> DataFrame:
    """(key, kind, field, category, severity, violation): a row for each rule that a record breaks, in one pass without a shuffle.

    An identifier that is filled is a critical violation; together quasi-identifiers or more are a warning, with their names in field.
    Where the column context says transmission, the field encrypted must be true, or it is a violation; where it says storage, access_controls must be,
    or it is a warning. Fields that records lack are not there, other columns aren't read. Repeated rows and null keys have findings of their own; an
    empty table has none.
    """
    row = lambda kind, field, category, severity, violation: F.struct(F.lit(kind).alias("kind"), field.cast("string").alias("field"), F.lit(category).cast("string").alias("category"), F.lit(severity).alias("severity"), F.lit(violation).alias("violation"))
    found = [F.when(filled(records, f), row("direct_identifier", F.lit(f), c, "critical", True)) for c, fields in identifiers.items() for f in fields if f in records.columns]
    some = F.array_compact(F.array(*(F.when(truthy(records, f), F.lit(f)) for f in quasi)))
    found.append(F.when(F.size(some) >= together, row("quasi_identifier_risk", F.array_join(some, ","), None, "medium", False)))
    if context is not None:
        at = F.col(f"`{context}`")
        found.append(F.when((at == "transmission") & ~truthy(records, "encrypted"), row("encryption_required", F.lit(None), None, "critical", True)))
        found.append(F.when((at == "storage") & ~truthy(records, "access_controls"), row("access_controls", F.lit(None), None, "medium", False)))
    return records.select(F.col(f"`{key}`"), F.explode(F.array_compact(F.array(*found))).alias("finding")).select(f"`{key}`", "finding.*")


def broken_rules(operations: DataFrame, rules: DataFrame, key: str = "id") -> DataFrame:
    """(key, regime, violation): for each operation the first rule, by place, that it breaks of each regime.

    operations has key, operation and flags (map of text to boolean); rules is a table as RULES_SCHEMA says, so a user adds or removes rules by
    rows. A rule is broken unless its flag is must_be; a flag that is missing or null is false. The rules of an operation's name are
    put into one row, and each operation meets this row: by broadcast if Spark finds the rules small, else by a shuffle in which adaptive
    execution splits frequent names. No rule for a name, or a null name: no row. Repeated operations have rows of their own.
    """
    by = rules.groupBy("operation").agg(F.sort_array(F.collect_list(F.struct("regime", "place", "flag", "must_be", "violation"))).alias("rules"))
    unlike = lambda r: F.coalesce(F.element_at("flags", r["flag"]), F.lit(False)) != r["must_be"]
    met = operations.select(F.col(f"`{key}`"), "operation", "flags").join(by, "operation").select(f"`{key}`", F.filter("rules", unlike).alias("broken"))
    first = F.filter("broken", lambda r, i: (i == 0) | ~F.get(F.col("broken"), i - 1)["regime"].eqNullSafe(r["regime"]))
    return met.select(f"`{key}`", F.explode(first).alias("r")).select(f"`{key}`", "r.regime", "r.violation")


def small_cohorts(records: DataFrame, group: str, fewer_than: int = 1000, fields: Sequence[str] = DEMOGRAPHIC) -> DataFrame:
    """(group, n, demographic, at_risk): groups of fewer rows than fewer_than in which some row holds a demographic field are at risk. Null is a group."""
    any_field = F.lit(False)
    for f in fields:
        any_field = any_field | truthy(records, f)
    by = records.groupBy(F.col(f"`{group}`")).agg(F.count("*").alias("n"), F.bool_or(any_field).alias("demographic"))
    return by.withColumn("at_risk", F.col("demographic") & (F.col("n") < fewer_than))


def credential_errors(npi: Column, baa_hash: Column, risk_hash: Column, hsm: Column) -> Column:
    """What is wrong with a provider's credentials, in order: npi (ten digits), baa_hash, risk_analysis_hash (64 characters), hsm_serial (not empty)."""
    right = {"npi": npi.rlike(r"\A[0-9]{10}\z"), "baa_hash": F.length(baa_hash) == 64, "risk_analysis_hash": F.length(risk_hash) == 64, "hsm_serial": hsm != ""}
    return F.array_compact(F.array(*(F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in right.items())))
