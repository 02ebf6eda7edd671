"""Spans, masks, tokens and findings against a plain scanner."""

import hashlib
import hmac
import random
import re

from pyspark.sql import functions as F

from strandlake.operators import redaction as R

TEXT = "Contact john.doe@example.com or +1-415-555-1212 from 192.168.0.5"


def scanned(text):
    found = [(m.start(), -m.end(), i, k, m[0]) for i, (k, p) in enumerate(R.PII.items()) for m in re.finditer(p, text)]
    return [(s, -e, k, v) for s, e, _, k, v in sorted(found)]


def rewritten(text, put):
    out, at = [], 0
    for start, end, kind, value in scanned(text):
        if start >= at:
            out += [text[at:start], put(kind, value)]
            at = end
    return "".join([*out, text[at:]])


def token(kind, value, key=b"testsecret"):
    return f"tok_{hmac.new(key, f'{kind}:{value}'.encode(), hashlib.sha256).hexdigest()[:16]}"


def corpus():
    rng = random.Random(1)
    parts = ["a.b@c.org", "4155551212@x.com", "(415) 555-1212", "1 415 555 1212", "10.0.0.255", "256.1.1.1", "123-45-6789", "é", "x", " ", "  ", ".", "-", "\n", "😀", "555-123-4567", "naïve.jo@ü.de", "9"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(1, 12))) for _ in range(400)]
    return [TEXT, "", "no data", *texts, "z " * 200_000 + "a.b@c.org"]


def test_spans_masks_and_tokens(spark):
    texts = corpus()
    text = F.col("text")
    frame = spark.createDataFrame([*enumerate(texts), (-1, None)], "id long, text string").repartition(4)
    got = {r["id"]: r for r in frame.select("id", R.pii_spans(text).alias("spans"), R.pii_masked(text).alias("masked"), R.pii_tokenized(text, b"testsecret").alias("tokens")).collect()}
    for i, t in enumerate(texts):
        assert [tuple(m) for m in got[i]["spans"]] == scanned(t), t[:80]
        assert got[i]["masked"] == rewritten(t, lambda k, _: f"[{k.upper()}]")
        assert got[i]["tokens"] == rewritten(t, token)
    assert got[-1]["masked"] is None and got[-1]["tokens"] is None
    assert got[0]["masked"] == "Contact [EMAIL] or +[PHONE] from [IPV4]"


def test_kinds_are_chosen(spark):
    frame = spark.createDataFrame([(TEXT,)], "text string")
    assert frame.select(R.pii_masked(F.col("text"), ["ipv4"])).first()[0] == TEXT.replace("192.168.0.5", "[IPV4]")


def test_hmac(spark):
    frame = spark.createDataFrame([("",), ("é message",), ("x" * 1000,)], "m string")
    for key in (b"", b"key", b"k" * 64, b"k" * 65):
        for m, h in frame.select("m", R.hmac_sha256(key, F.col("m"))).collect():
            assert h == hmac.new(key, m.encode(), hashlib.sha256).hexdigest()


LINES = """patient with genetic variant BRCA1A rs12345
MRN:1234567 npi 1234567890 ssn 123-45-6789
born 02/29/1980, chr7:5566 SRR123456 A1B ABCDEFG12345H
subject's diagnosis: jo.doe@mail.org +1-555-123-4567 rs99999

nothing here 12"""


def findings(text, patterns=R.PHI_KINDS):
    for n, line in enumerate(text.split("\n"), 1):
        context = [k for k, p in R.CONTEXT.items() if re.search(p, line, re.I)]
        for kind, (pattern, severity) in patterns.items():
            for m in re.finditer(pattern, line, re.I):
                if (kind == "npi" and not re.fullmatch(r"\d{10}", m[0])) or (kind == "gene_variant" and len(m[0]) > 10):
                    continue
                graver = {"low": "medium", "medium": "high"}.get(severity, severity) if len(context) >= 2 else severity
                yield (n, m.start(), kind, graver, m[0], tuple(context))


def test_phi_findings(spark):
    rows = [(1, LINES, 0), (2, None, 0), (3, "", 0), (4, LINES, 0), (5, "\n\nrs1234", 0)]
    frame = spark.createDataFrame(rows, "id long, text string, line int")
    got = sorted((r["id"], r["line"], r["column"], r["kind"], r["severity"], r["value"], tuple(r["indicators"])) for r in R.phi_findings(frame, "id", "text").collect())
    assert got == sorted((i, *x) for i, t, _ in rows if t for x in findings(t)) and len({x[3] for x in got}) == 10
    own = R.phi_findings(frame, "id", "text", {"born": (r"\bborn\b", "low")}, {"born": lambda v: v == "born"})
    assert own.where("kind = 'born'").count() == 2


def test_phi_masked(spark):
    def masked(text):
        for pattern, _ in R.PHI_KINDS.values():
            text = re.sub(pattern, lambda m: f"{m[0][0]}[REDACTED]{m[0][-1]}" if len(m[0]) > 2 else "[REDACTED]", text, flags=re.I)
        return text

    texts = [LINES, "", "plain", "12 rs12345é rs12345 é"]
    frame = spark.createDataFrame([(t,) for t in texts], "text string")
    assert [r[0] for r in frame.select(R.phi_masked(F.col("text"))).collect()] == [masked(t) for t in texts]
