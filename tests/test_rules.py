"""Findings of records and operations against plain walks over the same rules."""

import random

from pyspark.sql import functions as F

from strandlake.operators import rules as R

FIELDS = "id long, name string, birth_year int, zipcode string, gender string, diagnosis_codes array<string>, `a.b` string, encrypted boolean, access_controls boolean, context string, kind string"


def people(n=400):
    rng = random.Random(6)
    pick = lambda *x: rng.choice(x)
    rows = [(i, pick(None, "", " \t", "Ann"), pick(None, 0, 1950), pick(None, "", "12345"), pick("", " ", "f"), pick(None, [], ["E11"]), "x", pick(None, False, True), pick(None, False, True), pick(None, "general", "storage", "transmission"), "k") for i in range(n)]
    return [*rows, rows[0], (None, *rows[1][1:])]


def walked(r):
    _, name, year, zipcode, gender, codes, _, encrypted, controls, context, _ = r
    out = []
    if name is not None and name.strip():
        out.append(("direct_identifier", "name", "direct", "critical", True))
    if year is not None:
        out.append(("direct_identifier", "birth_year", "ages_over_89", "critical", True))
    some = [f for f, x in (("zipcode", zipcode), ("birth_year", year), ("gender", gender), ("diagnosis_codes", codes)) if x]
    if len(some) >= 3:
        out.append(("quasi_identifier_risk", ",".join(some), None, "medium", False))
    if context == "transmission" and not encrypted:
        out.append(("encryption_required", None, None, "critical", True))
    if context == "storage" and not controls:
        out.append(("access_controls", None, None, "medium", False))
    return out


def test_records(spark):
    rows = people()
    frame = spark.createDataFrame(rows, FIELDS).repartition(3)
    got = R.record_findings(frame, "id", "context")
    assert sorted((tuple(r) for r in got.collect()), key=str) == sorted(((r[0], *x) for r in rows for x in walked(r)), key=str)
    assert R.record_findings(frame.limit(0), "id", "context").count() == 0
    assert R.record_findings(frame.select("id", "kind"), "id").count() == 0
    plan = R.record_findings(spark.createDataFrame(rows, FIELDS), "id", "context")._jdf.queryExecution().executedPlan().toString()
    assert "Generate explode" in plan and "Exchange" not in plan


def test_operations(spark):
    rng = random.Random(7)
    names = sorted({r[2] for r in R.OPERATION_RULES}) + ["other", None]
    flags = sorted({r[3] for r in R.OPERATION_RULES})
    rows = [(i, rng.choice(names), {f: rng.choice([True, False, None]) for f in flags if rng.random() < 0.7}, "x") for i in range(500)] + [(500, "data_access", None, "x")]
    rows.append(rows[0])
    want = []
    for i, name, given, _ in rows:
        for regime in ("hipaa", "gdpr"):
            broken = [v for g, _, o, f, must, v in sorted(R.OPERATION_RULES) if g == regime and o == name and bool((given or {}).get(f)) != must]
            want += [(i, regime, broken[0])] if broken else []
    operations = spark.createDataFrame(rows, "id long, operation string, flags map<string,boolean>, rules string")
    table = spark.createDataFrame(R.OPERATION_RULES, R.RULES_SCHEMA)
    assert sorted(tuple(r) for r in R.broken_rules(operations, table).collect()) == sorted(want)
    more = table.unionByName(spark.createDataFrame([("own", 1, "other", "encrypted", True, "own_rule")], R.RULES_SCHEMA))
    others = [r for r in rows if r[1] == "other" and not (r[2] or {}).get("encrypted")]
    assert R.broken_rules(operations, more).where("regime = 'own'").count() == len(others) > 0
    assert R.broken_rules(operations, table.limit(0)).count() == 0 and R.broken_rules(operations.limit(0), table).count() == 0


def test_cohorts(spark):
    rows = [("a", None, "")] * 3 + [("b", 1950, None)] * 2 + [("c", 0, "f")] * 5 + [(None, 0, "m")]
    got = R.small_cohorts(spark.createDataFrame(rows, "g string, birth_year int, gender string"), "g", fewer_than=5).collect()
    assert sorted((tuple(r) for r in got), key=str) == sorted([("a", 3, False, False), ("b", 2, True, True), ("c", 5, True, False), (None, 1, True, True)], key=str)


def test_credentials(spark):
    h = "0" * 64
    rows = [("0123456789", h, h, "s"), ("0123456789\n", h, h[1:], ""), (None, None, None, None), ("012345678x", "é" * 64, h, "s")]
    got = spark.createDataFrame(rows, "a string, b string, c string, d string").select(R.credential_errors(*map(F.col, "abcd"))).collect()
    assert [r[0] for r in got] == [[], ["npi", "risk_analysis_hash", "hsm_serial"], ["npi", "baa_hash", "risk_analysis_hash", "hsm_serial"], ["npi"]]
