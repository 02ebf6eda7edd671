"""Clinical bundles: the entries of JSON bundles as tables of patients, observations, conditions, medications and family history.

A bundle is parsed once into a variant, its entries are exploded once, and one pass makes of each entry the record of its
kind. What can't be used is kept aside with the reason, so nothing is lost silently.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The names of resource types, and the tables that they make.
KINDS = {"Patient": "patients", "Observation": "observations", "Condition": "conditions", "MedicationStatement": "medications", "FamilyMemberHistory": "family"}


def _get(v: Column, path: str, kind: str = "string") -> Column:
    return F.try_variant_get(v, path, kind)


def _list(v: Column, path: str) -> Column:
    return F.coalesce(_get(v, path, "array<variant>"), F.array().cast("array<variant>"))


def _name(coding: Column) -> Column:
    return F.coalesce(_get(coding, "$.display"), _get(coding, "$.code"))


def _first(v: Column, path: str) -> Column:
    return F.get(_list(v, path), F.lit(0))


def _last_where(items: Column, test: Callable[[Column], Column], path: str) -> Column:
    return F.try_element_at(F.transform(F.filter(items, lambda x: F.coalesce(test(x), F.lit(False))), lambda x: _get(x, path)), F.lit(-1))


def _holds(v: Column, path: str, word: str) -> Column:
    return F.coalesce(F.lower(_get(v, path)).contains(word), F.lit(False))


def _time(v: Column, path: str) -> Column:
    return _get(v, path).try_cast("timestamp")


def _patient(r: Column, today: Column) -> Column:
    more = _list(r, "$.extension")
    born = _get(r, "$.birthDate").try_cast("date")
    race = lambda x: _holds(x, "$.url", "race")
    return F.struct(
        born.alias("birth_date"), F.floor(F.date_diff(today, born) / 365).cast("int").alias("age"), _get(r, "$.gender").alias("gender"),
        _last_where(more, race, "$.valueString").alias("race"), _last_where(more, lambda x: ~race(x) & _holds(x, "$.url", "ethnicity"), "$.valueString").alias("ethnicity"),
    )


def _observation(r: Column, own_id: Column) -> Column:
    code, has = _first(r, "$.code.coding"), lambda key: _get(r, f"$.{key}", "variant").isNotNull()
    value = F.when(has("valueQuantity"), _get(r, "$.valueQuantity.value")).when(has("valueString"), _get(r, "$.valueString")).otherwise(_get(r, "$.valueBoolean"))
    return F.when(
        code.isNotNull() & value.isNotNull(),
        F.struct(
            own_id.alias("measurement_id"), _name(code).alias("measurement"), value.alias("value"), value.try_cast("double").alias("number"), F.when(has("valueQuantity"), _get(r, "$.valueQuantity.unit")).alias("unit"),
            _time(r, "$.effectiveDateTime").alias("at"), _get(code, "$.system").alias("code_system"), _get(code, "$.code").alias("code"),
            _get(r, "$.referenceRange[0].low.value", "double").alias("low"), _get(r, "$.referenceRange[0].high.value", "double").alias("high"), _get(r, "$.interpretation[0].coding[0].code").alias("abnormal"),
        ),
    )


def _condition(r: Column, own_id: Column) -> Column:
    codes = _list(r, "$.code.coding")
    code = F.get(codes, F.lit(0))
    icd = lambda x: _holds(x, "$.system", "icd")
    return F.when(
        code.isNotNull(),
        F.struct(
            own_id.alias("diagnosis_id"), _name(code).alias("name"), _time(r, "$.onsetDateTime").alias("onset"), F.when(_get(r, "$.clinicalStatus.coding[0].code") == "active", "active").otherwise("resolved").alias("status"),
            _last_where(codes, icd, "$.code").alias("icd10"), _last_where(codes, lambda x: ~icd(x) & _holds(x, "$.system", "snomed"), "$.code").alias("snomed"), _get(r, "$.severity.coding[0].display").alias("severity"),
        ),
    )


def _medication(r: Column, own_id: Column) -> Column:
    codes = _list(r, "$.medicationCodeableConcept.coding")
    code, dose = F.get(codes, F.lit(0)), "$.dosage[0].doseAndRate[0].doseQuantity"
    measured = F.nullif(F.concat_ws(" ", _get(r, f"{dose}.value"), _get(r, f"{dose}.unit")), F.lit(""))
    return F.when(
        code.isNotNull(),
        F.struct(
            own_id.alias("medication_id"), _name(code).alias("name"), _time(r, "$.effectivePeriod.start").alias("start"), _time(r, "$.effectivePeriod.end").alias("end"), F.coalesce(_get(r, "$.status"), F.lit("active")).alias("status"),
            _last_where(codes, lambda x: _holds(x, "$.system", "rxnorm"), "$.code").alias("rxnorm"), F.coalesce(_get(r, "$.dosage[0].text"), measured).alias("dose"),
            _get(r, "$.dosage[0].route.coding[0].display").alias("route"), _get(r, "$.reasonCode[0].coding[0].display").alias("indication"),
        ),
    )


def _family(r: Column) -> Column:
    relation = _first(r, "$.relationship.coding")
    coded = F.filter(_list(r, "$.condition"), lambda c: _get(c, "$.code.coding[0]", "variant").isNotNull())
    one = lambda c: F.struct(_name(relation).alias("relationship"), _name(_get(c, "$.code.coding[0]", "variant")).alias("condition"), _get(c, "$.onsetAge.value", "double").alias("age_at_onset"), _get(c, "$.outcome.coding[0].display").alias("outcome"))
    return F.when(relation.isNotNull() & (F.size(coded) > 0), F.transform(coded, one))


def fhir_records(bundles: DataFrame, id_col: str = "bundle", text_col: str = "text", today: Column | None = None) -> DataFrame:
    """bundles (id, JSON text) to one row for each entry: bundle, entry (from 0), kind, one record column of five, and rejected.

    kind is the resource type. rejected says why an entry, or a whole bundle, has no record: "not json", "no entries", "no type",
    "other type", or "incomplete" (an observation without code or value, a condition or medication without code, a family history
    without relationship or conditions with codes). A quantity comes before a string and a boolean, also when its value is missing.
    A field of the wrong type is null. A missing id is the first 8 digits of the resource's SHA-256. Ages are whole years
    of 365 days up to today (a date column; default: the current date). A null text is not json.
    """
    today = F.current_date() if today is None else today
    # a text that is no JSON has no variant; entries of a bundle are exploded once
    parsed = bundles.select(F.col(f"`{id_col}`").alias("bundle"), F.try_parse_json(F.col(f"`{text_col}`").cast("string")).alias("v"))
    listed = _list(F.col("v"), "$.entry")
    entries = parsed.select("bundle", F.col("v").isNotNull().alias("json"), F.posexplode_outer(listed).alias("entry", "x"))
    # the kind is read where it stands: a filter on it takes no part of the bundle out for entries of other kinds
    rows = entries.select("bundle", "json", "entry", _get(F.col("x"), "$.resource", "variant").alias("r"), _get(F.col("x"), "$.resource.resourceType").alias("kind"))
    r = F.col("r")
    own_id = F.coalesce(_get(r, "$.id"), F.left(F.sha2(F.to_json(r), 256), F.lit(8)))
    records = {
        "Patient": _patient(r, today),
        "Observation": _observation(r, own_id),
        "Condition": _condition(r, own_id),
        "MedicationStatement": _medication(r, own_id),
        "FamilyMemberHistory": _family(r),
    }
    out = rows.select("bundle", "entry", "kind", "json", *(F.when(F.col("kind") == k, v).alias(KINDS[k]) for k, v in records.items()))
    any_record = F.greatest(*(F.col(c).isNotNull() for c in KINDS.values()))
    why = F.when(any_record, None).when(~F.col("json"), "not json").when(F.col("entry").isNull(), "no entries").when(F.col("kind").isNull(), "no type").when(~F.col("kind").isin(*KINDS), "other type").otherwise("incomplete")
    return out.withColumn("rejected", why).drop("json")


def fhir_table(records: DataFrame, name: str) -> DataFrame:
    """One of the five tables (a value of KINDS) of what fhir_records gives: bundle, entry and the record's fields; family history has a row for each condition."""
    own = records.where(F.col(name).isNotNull())
    if name == "family":
        return own.select("bundle", "entry", F.explode(name).alias("x")).select("bundle", "entry", "x.*")
    return own.select("bundle", "entry", f"{name}.*")
