"""A bundle of all types, read literally, and what is kept aside."""

import datetime as dt
import hashlib
import json

import pytest
from pyspark.sql import functions as F

from strandlake.sources import fhir_records, fhir_table

CODE = lambda *c: {"coding": [dict(zip(("system", "code", "display"), x, strict=False)) for x in c]}
ENTRIES = [
    {"resourceType": "Patient", "birthDate": "1980-02-29", "gender": "female", "extension": [{"url": "us-race", "valueString": "a"}, {"url": "ethnicity", "valueString": "b"}, {"url": "RACE", "valueString": "c"}]},
    {"resourceType": "Observation", "id": "o1", "code": CODE(("http://loinc.org", "718-7", "Hemoglobin"), ("x", "y", "z")), "valueQuantity": {"value": 6.5, "unit": "g/dL"}, "effectiveDateTime": "2024-01-02T03:04:05Z", "referenceRange": [{"low": {"value": 4}}], "interpretation": [CODE(("i", "L"))]},
    {"resourceType": "Observation", "id": "o2", "code": CODE(("s", "c2")), "valueString": "positive"},
    {"resourceType": "Observation", "id": "o3", "code": CODE(("s", "c3")), "valueBoolean": False},
    {"resourceType": "Observation", "id": "o4", "code": CODE(("s", "c4")), "valueQuantity": {"unit": "x"}, "valueString": "not taken"},
    {"resourceType": "Observation", "id": "o5", "code": {"coding": []}, "valueString": "no code"},
    {"resourceType": "Condition", "code": CODE(("icd-10", "E11", "Diabetes"), ("SNOMED", "44054006")), "clinicalStatus": CODE(("s", "active")), "severity": CODE(("s", "1", "severe")), "onsetDateTime": "2020-05-06"},
    {"resourceType": "Condition", "id": "d2", "code": CODE(("other", "X1"))},
    {"resourceType": "MedicationStatement", "id": "m1", "medicationCodeableConcept": CODE(("RxNorm", "860975", "Metformin")), "effectivePeriod": {"start": "2021-01-01", "end": "bad date"}, "dosage": [{"doseAndRate": [{"doseQuantity": {"value": 500, "unit": "mg"}}], "route": CODE(("r", "1", "oral"))}], "reasonCode": [CODE(("r", "2", "sugar"))]},
    {"resourceType": "MedicationStatement", "id": "m2", "status": "stopped", "medicationCodeableConcept": CODE(("s", "b")), "dosage": [{"text": "daily"}]},
    {"resourceType": "FamilyMemberHistory", "relationship": CODE(("r", "FTH", "father")), "condition": [{"code": CODE(("c", "1", "asthma")), "onsetAge": {"value": 40}, "outcome": CODE(("o", "2", "died"))}, {"code": {}}, {"code": CODE(("c", "gout"))}]},
    {"resourceType": "FamilyMemberHistory", "relationship": CODE(("r", "MTH")), "condition": []},
    {"resourceType": "Device"},
    {"id": "no type"},
    {"resourceType": "Observation", "id": 5, "code": "wrong type", "valueQuantity": "wrong"},
]


@pytest.fixture(scope="module")
def records(spark):
    whole = json.dumps({"resourceType": "Bundle", "entry": [{"resource": x} for x in ENTRIES]})
    rows = [(1, whole), (2, "{not json"), (3, None), (4, "{}"), (5, '{"entry": []}'), (6, '{"entry": 7}'), (7, '{"entry": [3, null]}'), (7, '{"entry": [3, null]}')]
    frame = spark.createDataFrame([(i, t, 0, "x") for i, t in rows], "bundle long, text string, entry int, kind string")
    return fhir_records(frame, today=F.lit("2024-02-28").cast("date")).cache()


def rows_of(records, name):
    return [tuple(r)[2:] for r in fhir_table(records, name).orderBy("bundle", "entry").collect()]


def seconds(*parts):
    return int(dt.datetime(*parts, tzinfo=dt.timezone.utc).timestamp())


def test_tables(records):
    assert rows_of(records, "patients") == [(dt.date(1980, 2, 29), 44, "female", "c", "b")]
    got = fhir_table(records, "observations").withColumn("at", F.unix_timestamp("at")).orderBy("entry").collect()
    assert [tuple(r)[2:] for r in got] == [
        ("o1", "Hemoglobin", "6.5", 6.5, "g/dL", seconds(2024, 1, 2, 3, 4, 5), "http://loinc.org", "718-7", 4.0, None, "L"),
        ("o2", "c2", "positive", None, None, None, "s", "c2", None, None, None),
        ("o3", "c3", "false", None, None, None, "s", "c3", None, None, None),
    ]
    (first, second) = fhir_table(records, "conditions").orderBy("entry").collect()
    assert tuple(first)[3] == "Diabetes" and tuple(first)[5:] == ("active", "E11", "44054006", "severe") and len(first["diagnosis_id"]) == 8
    assert tuple(second)[2:] == ("d2", "X1", None, "resolved", None, None, None)
    got = fhir_table(records, "medications").orderBy("entry").collect()
    assert [(r["medication_id"], r["name"], r["end"], r["status"], r["rxnorm"], r["dose"], r["route"], r["indication"]) for r in got] == [
        ("m1", "Metformin", None, "active", "860975", "500 mg", "oral", "sugar"),
        ("m2", "b", None, "stopped", None, "daily", None, None),
    ]
    assert sorted(rows_of(records, "family"), key=str) == [("father", "asthma", 40.0, "died"), ("father", "gout", None, None)]


def test_nothing_is_lost(records):
    got = sorted((r["bundle"], -1 if r["entry"] is None else r["entry"], r["rejected"]) for r in records.where("rejected is not null").collect())
    one = [(1, i, w) for i, w in ((4, "incomplete"), (5, "incomplete"), (11, "incomplete"), (12, "other type"), (13, "no type"), (14, "incomplete"))]
    assert got == [*one, (2, -1, "not json"), (3, -1, "not json"), (4, -1, "no entries"), (5, -1, "no entries"), (6, -1, "no entries"), *sorted([(7, 0, "no type"), (7, 1, "no type")] * 2)]
    kept = sum(fhir_table(records, name).select("bundle", "entry").distinct().count() for name in ("patients", "observations", "conditions", "medications", "family"))
    assert kept + 6 == len(ENTRIES)


def test_ids_are_stable(spark):
    text = json.dumps({"entry": [{"resource": {"resourceType": "Condition", "code": CODE(("a", "b"))}}]})
    (row,) = fhir_table(fhir_records(spark.createDataFrame([(1, text)], "bundle long, text string")), "conditions").collect()
    assert row["diagnosis_id"] == hashlib.sha256(b'{"code":{"coding":[{"code":"b","system":"a"}]},"resourceType":"Condition"}').hexdigest()[:8]
