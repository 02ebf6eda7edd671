"""Personal and health data in texts, field policies, and noise for differential privacy."""

from __future__ import annotations

import math
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A smaller set of kinds of health data, with patterns and severities of this library's own; redaction.PHI_KINDS has the ten.
PHI = {
    "ssn": (r"\b\d{3}-\d{2}-\d{4}\b", "critical"),
    "mrn": (r"\bMRN[:#]?\s?\d{6,10}\b", "high"),
    "phone": (r"\b\d{3}[-.]\d{3}[-.]\d{4}\b", "medium"),
    "email": (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}", "medium"),
    "ip": (r"\b\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}\b", "low"),
    "date": (r"\b\d{4}-\d{2}-\d{2}\b", "low"),
}
LEVELS = ("public", "confidential", "restricted")


def findings(texts: DataFrame, key: str, text: str, patterns: Mapping[str, tuple[str, str]] = PHI) -> DataFrame:
    """(key, kind, severity, value): a row for each match of each pattern, in one pass; case counts for nothing."""

    def found_by(kind, pattern, severity):
        return F.transform(F.regexp_extract_all(F.col(text), F.lit(f"(?i)({pattern})"), F.lit(1)), lambda v: F.struct(F.lit(kind).alias("kind"), F.lit(severity).alias("severity"), v.alias("value")))

    found = [found_by(k, p, s) for k, (p, s) in patterns.items()]
    return texts.select(key, F.explode(F.flatten(F.array(*found))).alias("x")).select(key, "x.*")


def masked(text: Column, patterns: Mapping[str, tuple[str, str]] = PHI) -> Column:
    """text with [REDACTED] for each match, pattern by pattern."""
    for p, _ in patterns.values():
        text = F.regexp_replace(text, f"(?i){p}", "[REDACTED]")
    return text


def first_kind(text: Column, patterns: Mapping[str, tuple[str, str]] = PHI) -> Column:
    """The first kind, in their order, that text has; null for none."""
    return F.coalesce(*(F.when(text.rlike(f"(?i){p}"), F.lit(k)) for k, (p, _) in patterns.items()))


def token(kind: Column, value: Column, key: str) -> Column:
    """tok_ and 16 hex digits of a keyed hash of kind and value."""
    return F.concat(F.lit("tok_"), F.substring(F.sha2(F.concat_ws(":", F.lit(key), kind, value), 256), 1, 16))


def highest_level(present: Mapping[str, Column], policy: Mapping[str, str]) -> Column:
    """The highest level of the fields that are there; public for none."""
    ranks = [F.when(there, LEVELS.index(policy[field])).otherwise(0) for field, there in present.items()]
    return F.element_at(F.array(*(F.lit(x) for x in LEVELS)), F.greatest(F.lit(0), *ranks) + 1)


def laplace_scale(sensitivity: Column, epsilon: Column) -> Column:
    return sensitivity / epsilon


def gaussian_sigma(sensitivity: Column, epsilon: Column, delta: float) -> Column:
    return sensitivity * math.sqrt(2 * math.log(1.25 / delta)) / epsilon
