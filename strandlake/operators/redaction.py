"""Personal and health data by place: spans, masks and keyed tokens in texts, and findings by line with their context.

Everything is built from column expressions. Where a pattern matches is read off the pieces between its matches, so no
Python sees a text. Patterns use Unicode's word boundaries and digits, as Python's do.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Kinds of personal data and their patterns.
PII = {
    "email": r"\b[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[A-Za-z]{2,}\b",
    "phone": r"\b(?:\+?1[-.\s]?)?(?:\(?\d{3}\)?[-.\s]?)\d{3}[-.\s]?\d{4}\b",
    "ipv4": r"\b(?:(?:25[0-5]|2[0-4]\d|[01]?\d\d?)\.){3}(?:25[0-5]|2[0-4]\d|[01]?\d\d?)\b",
    "ssn": r"\b\d{3}-\d{2}-\d{4}\b",
}

# Kinds of health data, their patterns and severities; case counts for nothing.
PHI_KINDS = {
    "ssn": (r"\b\d{3}-\d{2}-\d{4}\b", "critical"),
    "npi": (r"\b\d{10}\b", "high"),
    "genomic_coords": (r"\bchr[0-9XYM]+[:_]\d+\b", "high"),
    "rsid": (r"\brs\d{4,}\b", "medium"),
    "dob": (r"\b(?:0[1-9]|1[0-2])[/-](?:0[1-9]|[12]\d|3[01])[/-](?:19|20)\d{2}\b", "high"),
    "mrn": (r"\b(?:MRN|mrn)[:\s]?\d{6,}\b", "critical"),
    "email_with_name": (r"\b[A-Za-z]+\.[A-Za-z]+@[A-Za-z]+\.[A-Za-z]+\b", "medium"),
    "phone": (r"\b(?:\+1-)?\d{3}[-.\s]?\d{3}[-.\s]?\d{4}\b", "medium"),
    "gene_variant": (r"\b[A-Z]+\d+[A-Z]+\b", "low"),
    "sequencing_id": (r"\b(?:SRR|ERR|DRR)\d{6,}\b", "medium"),
}

# Words of a line that make a finding in it graver.
CONTEXT = {
    "patient": r"\b(?:patient|subject|participant|individual)\b",
    "diagnosis": r"\b(?:diagnosis|diagnosed|condition|disease)\b",
    "treatment": r"\b(?:treatment|medication|drug|therapy)\b",
    "genetic": r"\b(?:genetic|genomic|variant|mutation)\b",
}

#: What a match must be, beside what its pattern says.
VALIDATORS: dict[str, Callable[[Column], Column]] = {"npi": lambda v: v.rlike("^[0-9]{10}$"), "gene_variant": lambda v: F.length(v) <= 10}


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), where value is computed once however often use names it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def matches(text: Column, pattern: str, flags: str = "U") -> Column:
    """The matches of a pattern as an array of (start, end, value), in code points, end exclusive; the pattern has no groups and no empty match."""
    found = F.regexp_extract_all(text, F.lit(f"(?{flags})({pattern})"), F.lit(1))
    between = F.split(text, f"(?{flags}){pattern}", -1)
    # where each match ends is the length of all pieces and matches up to it
    steps = F.zip_with(F.slice(between, F.lit(1), F.size(found)), found, lambda b, v: F.struct(F.length(b).alias("gap"), v.alias("value")))
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int,value:string>>").alias("out"))

    def place(s: Column, x: Column) -> Column:
        begin = s["at"] + x["gap"]
        end = begin + F.length(x["value"])
        return F.struct(end.alias("at"), F.concat(s["out"], F.array(F.struct(begin.alias("start"), end.alias("end"), x["value"].alias("value")))).alias("out"))

    return F.when(F.size(found) > 0, F.aggregate(steps, start, place)["out"]).otherwise(F.array().cast("array<struct<start:int,end:int,value:string>>"))


def pii_spans(text: Column, kinds: Iterable[str] | None = None) -> Column:
    """All matches of the kinds as an array of (start, end, kind, value), by start, longer first; equal spans in the kinds' order. They may overlap."""

    def of(place: int, kind: str) -> Column:
        return F.transform(matches(text, PII[kind]), lambda m: F.struct(m["start"].alias("start"), (-m["end"]).alias("less"), F.lit(place).alias("place"), F.lit(kind).alias("kind"), m["value"].alias("value")))

    each = [of(i, k) for i, k in enumerate(PII) if kinds is None or k in kinds]
    return F.transform(F.sort_array(F.concat(*each)), lambda m: F.struct(m["start"].alias("start"), (-m["less"]).alias("end"), m["kind"].alias("kind"), m["value"].alias("value")))


def apart(spans: Column) -> Column:
    """Sorted spans without those that begin within one that stays, as one fold from left to right; each says with `after` where the one before it ended."""
    none = F.array().cast("array<struct<start:int,end:int,kind:string,value:string,after:int>>")

    def keep(s: Column, m: Column) -> Column:
        one = F.struct(m["start"].alias("start"), m["end"].alias("end"), m["kind"].alias("kind"), m["value"].alias("value"), s["at"].alias("after"))
        return F.when(m["start"] >= s["at"], F.struct(m["end"].alias("at"), F.concat(s["out"], F.array(one)).alias("out"))).otherwise(s)

    return F.aggregate(spans, F.struct(F.lit(0).alias("at"), none.alias("out")), keep)["out"]


def rewritten(text: Column, spans: Column, put: Callable[[Column], Column]) -> Column:
    """text with put(span) for each span; spans are sorted and apart."""

    def put_in(own: Column) -> Column:
        pieces = F.transform(own, lambda m: F.concat(F.substring(text, m["after"] + 1, m["start"] - m["after"]), put(m)))
        return F.concat(F.array_join(pieces, ""), F.substring(text, F.coalesce(F.try_element_at(own, F.lit(-1))["end"], F.lit(0)) + 1, F.length(text)))

    return bound(spans, put_in)


def hmac_sha256(key: bytes, message: Column) -> Column:
    """The keyed hash of RFC 2104 as hex, from two nested hashes; the key's pads are constants."""
    import hashlib

    block = (hashlib.sha256(key).digest() if len(key) > 64 else key).ljust(64, b"\0")
    inner = F.sha2(F.concat(F.lit(bytes(x ^ 0x36 for x in block)), message.cast("binary")), 256)
    return F.sha2(F.concat(F.lit(bytes(x ^ 0x5C for x in block)), F.unhex(inner)), 256)


def pii_token(key: bytes, kind: Column, value: Column) -> Column:
    """tok_ and the first 16 hex digits of the keyed hash of kind:value: equal values have equal tokens, and none tells its value."""
    return F.concat(F.lit("tok_"), F.left(hmac_sha256(key, F.concat(kind, F.lit(":"), value)), F.lit(16)))


def pii_masked(text: Column, kinds: Iterable[str] | None = None) -> Column:
    """text with [EMAIL], [PHONE], [IPV4] or [SSN] for each span; of spans that overlap the first counts, of those that begin together the longest."""
    return rewritten(text, apart(pii_spans(text, kinds)), lambda m: F.concat(F.lit("["), F.upper(m["kind"]), F.lit("]")))


def pii_tokenized(text: Column, key: bytes, kinds: Iterable[str] | None = None) -> Column:
    """text with a token for each span (see pii_masked and pii_token). A null text stays null in both."""
    return rewritten(text, apart(pii_spans(text, kinds)), lambda m: pii_token(key, m["kind"], m["value"]))


def phi_findings(texts: DataFrame, key: str, text: str, patterns: Mapping[str, tuple[str, str]] | None = None, validators: Mapping[str, Callable[[Column], Column]] | None = None) -> DataFrame:
    """(key, line from 1, column from 0, kind, severity, value, indicators): every match in every line that its kind's validator lets pass.

    indicators lists the kinds of context words that the line has; with two of them or more a low finding is medium and a medium one high.
    patterns and validators add kinds of one's own or replace given ones. Kinds may overlap. A null text has no line.
    """
    kinds, checks = PHI_KINDS | dict(patterns or {}), VALIDATORS | dict(validators or {})
    whole = F.col(f"`{text}`")
    anything = "|".join(f"(?:{p})" for p, _ in kinds.values())
    lines = texts.where(whole.rlike(f"(?iU){anything}")).select(F.col(f"`{key}`"), F.posexplode(F.split(whole, "\n", -1)).alias("_at", "_line")).where(F.col("_line").rlike(f"(?iU){anything}"))
    line = F.col("_line")
    indicators = F.array_compact(F.array(*(F.when(line.rlike(f"(?iU){p}"), F.lit(k)) for k, p in CONTEXT.items())))

    def found(kind: str, pattern: str, severity: str) -> Column:
        own = matches(line, pattern, "iU")
        own = F.filter(own, lambda m: checks[kind](m["value"])) if kind in checks else own
        graver = {"low": "medium", "medium": "high"}.get(severity, severity)
        return F.transform(own, lambda m: F.struct(m["start"].alias("column"), F.lit(kind).alias("kind"), F.when(F.size("indicators") >= 2, graver).otherwise(severity).alias("severity"), m["value"].alias("value")))

    each = F.concat(*(found(k, p, s) for k, (p, s) in kinds.items()))
    return lines.withColumn("indicators", indicators).select(key, (F.col("_at") + 1).alias("line"), F.explode(each).alias("x"), "indicators").select(key, "line", "x.column", "x.kind", "x.severity", "x.value", "indicators")


def phi_masked(text: Column, patterns: Mapping[str, tuple[str, str]] | None = None) -> Column:
    """text with [REDACTED] inside each match, whose first and last character stay; one of two characters or less goes whole. Kind after kind, so later ones see what earlier ones left."""

    def masked(pattern: str) -> Callable[[Column], Column]:
        mask = lambda v: F.when(F.length(v) > 2, F.concat(F.left(v, F.lit(1)), F.lit("[REDACTED]"), F.right(v, F.lit(1)))).otherwise("[REDACTED]")
        found = lambda t: F.transform(F.regexp_extract_all(t, F.lit(f"(?iU)({pattern})"), F.lit(1)), mask)
        joined = lambda t: F.array_join(F.zip_with(F.split(t, f"(?iU){pattern}", -1), found(t), lambda b, v: F.concat(b, F.coalesce(v, F.lit("")))), "")
        return lambda t: F.when(t.rlike(f"(?iU){pattern}"), joined(t)).otherwise(t)

    for pattern, _ in (PHI_KINDS | dict(patterns or {})).values():
        text = bound(text, masked(pattern))
    return text
