"""Personal and health data, policies and privacy noise on the tables, with the SQL of each."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import vectors as V
from ..operators import blocks, privacy, redaction
from ..sources import table

QUERIES, SQL = {}, {}


def query(sql: str):
    def add(f):
        QUERIES[f.__name__], SQL[f.__name__] = f, sql
        return f

    return add


def _quoted(x: str) -> str:
    return x.replace("'", "''")


FOUND = "f AS (" + " UNION ALL ".join(f"SELECT doc_id, '{k}' AS kind, '{s}' AS severity, unnest(regexp_extract_all(text, '(?i)({_quoted(p)})', 0)) AS value FROM documents" for k, (p, s) in privacy.PHI.items()) + ")"


def _found(spark, sf):
    return privacy.findings(table(spark, sf, "documents"), "doc_id", "text")


@query(f"WITH {FOUND} SELECT doc_id, kind, count(*) AS n FROM f GROUP BY doc_id, kind")
def phi_scan(spark, sf):
    return _found(spark, sf).groupBy("doc_id", "kind").agg(F.count("*").alias("n"))


@query(f"WITH {FOUND} SELECT severity, count(*) AS n FROM f GROUP BY severity")
def phi_by_severity(spark, sf):
    return _found(spark, sf).groupBy("severity").agg(F.count("*").alias("n"))


@query(f"WITH {FOUND}, r AS (SELECT *, row_number() OVER (PARTITION BY severity ORDER BY doc_id, kind, value) AS rank FROM f) SELECT severity, rank::INT AS rank, doc_id, kind FROM r WHERE rank <= 10")
def phi_report_top10(spark, sf):
    w = W.partitionBy("severity").orderBy("doc_id", "kind", "value")
    return _found(spark, sf).withColumn("rank", F.row_number().over(w)).where("rank <= 10").select("severity", "rank", "doc_id", "kind")


def _masked_sql():
    text = "text"
    for p, _ in privacy.PHI.values():
        text = f"regexp_replace({text}, '(?i){_quoted(p)}', '[REDACTED]', 'g')"
    return text


@query(f"SELECT doc_id, md5({_masked_sql()}) AS redacted FROM documents")
def phi_redact(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.md5(privacy.masked(F.col("text")).cast("binary")).alias("redacted"))


#: What is watched for in conversations: health data, and patterns of one's own.
WATCHED = privacy.PHI | {"number": (r"\b\d+\b", "low"), "article": (r" the ", "low")}


@query("WITH k AS (SELECT conv_id, turn, CASE " + " ".join(f"WHEN regexp_matches(text, '(?i){_quoted(p)}') THEN '{k}'" for k, (p, _) in WATCHED.items()) + " END AS kind FROM conversations), r AS (SELECT *, row_number() OVER (PARTITION BY role_of ORDER BY turn) AS rn FROM (SELECT conv_id AS role_of, turn, kind FROM k WHERE kind IS NOT NULL)) SELECT role_of AS conv_id, count(*) AS found, count(*) FILTER (rn % 5 = 0) AS alerts FROM r GROUP BY role_of")
def phi_stream(spark, sf):
    """The first kind of each turn counts; every fifth finding of a conversation is an alert."""
    kinds = table(spark, sf, "conversations").select("conv_id", "turn", privacy.first_kind(F.col("text"), WATCHED).alias("kind")).where("kind is not null")
    ranked = kinds.withColumn("rn", F.row_number().over(W.partitionBy("conv_id").orderBy("turn")))
    return ranked.groupBy("conv_id").agg(F.count("*").alias("found"), F.count_if(F.col("rn") % 5 == 0).alias("alerts"))


@query(f"WITH {FOUND} SELECT doc_id, kind, 'tok_' || substr(sha256(concat('k1:', kind, ':', value)), 1, 16) AS token FROM f WHERE kind IN ('email', 'phone')")
def pii_tokens(spark, sf):
    some = _found(spark, sf).where(F.col("kind").isin("email", "phone"))
    return some.select("doc_id", "kind", privacy.token(F.col("kind"), F.col("value"), "k1").alias("token"))


@query("SELECT c_custkey, CASE WHEN c_acctbal < 0 THEN 'restricted' WHEN c_mktsegment = 'BUILDING' THEN 'confidential' ELSE 'public' END AS level FROM customer")
def classify_fields(spark, sf):
    present = {"ssn": F.col("c_acctbal") < 0, "address": F.col("c_mktsegment") == "BUILDING", "age": F.lit(True)}
    return table(spark, sf, "customer").select("c_custkey", privacy.highest_level(present, {"ssn": "restricted", "address": "confidential", "age": "public"}).alias("level"))


@query("SELECT c_custkey, round(least(1, 0.2 * (c_acctbal > 5000)::INT + 0.3 * (c_nationkey > 12)::INT + 0.6 * (c_mktsegment = 'BUILDING')::INT), 6)::DOUBLE AS risk FROM customer")
def risk_factors(spark, sf):
    parts = 0.2 * (F.col("c_acctbal") > 5000).cast("int") + 0.3 * (F.col("c_nationkey") > 12).cast("int") + 0.6 * (F.col("c_mktsegment") == "BUILDING").cast("int")
    return table(spark, sf, "customer").select("c_custkey", F.round(F.least(F.lit(1.0), parts), 6).alias("risk"))


@query("SELECT event_id, CASE WHEN value / 490 < 0.3 THEN 'low' WHEN value / 490 < 0.7 THEN 'moderate' ELSE 'high' END AS risk FROM events")
def risk_bucket(spark, sf):
    r = F.col("value") / 490
    return table(spark, sf, "events").select("event_id", F.when(r < 0.3, "low").when(r < 0.7, "moderate").otherwise("high").alias("risk"))


@query("SELECT n_nationkey, round((n_regionkey + 1) / (0.1 * (n_nationkey + 1)), 6) AS laplace, round((n_regionkey + 1) * sqrt(2 * ln(1.25 / 1e-5)) / (0.1 * (n_nationkey + 1)), 6) AS sigma FROM nation")
def dp_calibration(spark, sf):
    s, e = F.col("n_regionkey") + 1, 0.1 * (F.col("n_nationkey") + 1)
    return table(spark, sf, "nation").select("n_nationkey", F.round(privacy.laplace_scale(s, e), 6).alias("laplace"), F.round(privacy.gaussian_sigma(s, e, 1e-5), 6).alias("sigma"))


@query("SELECT c_custkey, 'prohibited' AS violation FROM customer WHERE c_name LIKE '%7' UNION ALL SELECT c_custkey, 'quasi_identifiers' FROM customer WHERE (c_nationkey > 5)::INT + (c_acctbal > 0)::INT + (c_mktsegment <> 'BUILDING')::INT >= 3")
def hipaa_check(spark, sf):
    """A row for each violation: a prohibited field, or three quasi-identifiers at once."""
    quasi = sum((x.cast("int") for x in (F.col("c_nationkey") > 5, F.col("c_acctbal") > 0, F.col("c_mktsegment") != "BUILDING")), F.lit(0))
    found = F.array_compact(F.array(F.when(F.col("c_name").like("%7"), F.lit("prohibited")), F.when(quasi >= 3, F.lit("quasi_identifiers"))))
    return table(spark, sf, "customer").select("c_custkey", F.explode(found).alias("violation"))


@query("SELECT event_id, CASE WHEN event_type = 'error' THEN 'deny' WHEN event_type = 'purchase' AND value > 200 THEN 'review' ELSE 'allow' END AS ruling FROM events")
def compliance_ops(spark, sf):
    ruling = F.when(F.col("event_type") == "error", "deny").when((F.col("event_type") == "purchase") & (F.col("value") > 200), "review").otherwise("allow")
    return table(spark, sf, "events").select("event_id", ruling.alias("ruling"))


@query("""WITH s AS (SELECT event_id // 500 AS slice, count(*) AS n, avg(value) AS m, stddev_pop(value) AS d, max(value) AS top FROM events GROUP BY 1)
SELECT slice, any_value(n) AS n, round(any_value(m), 5) AS mean, any_value(top) AS top, count(*) FILTER (abs(value - m) > 2 * d) AS anomalies, md5(string_agg(event_id::VARCHAR, ',' ORDER BY event_id)) AS hash FROM events JOIN s ON event_id // 500 = slice GROUP BY slice""")
def slice_summary(spark, sf):
    rows = table(spark, sf, "events").select(F.expr("event_id div 500").alias("slice"), "event_id", "value")
    w = W.partitionBy("slice")
    marked = rows.withColumn("odd", F.abs(F.col("value") - F.avg("value").over(w)) > 2 * F.stddev_pop("value").over(w))
    ids = F.array_join(F.transform(F.sort_array(F.collect_list("event_id")), lambda x: x.cast("string")), ",")
    return marked.groupBy("slice").agg(F.count("*").alias("n"), F.round(F.avg("value"), 5).alias("mean"), F.max("value").alias("top"), F.count_if("odd").alias("anomalies"), F.md5(ids.cast("binary")).alias("hash"))


@query("WITH r AS (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY p_retailprice DESC, p_partkey) AS r, count(*) OVER (PARTITION BY p_brand) AS n FROM part), t AS (SELECT p_brand, min(p_retailprice) AS least FROM r WHERE r <= n - floor(n * 0.1) GROUP BY p_brand) SELECT p_partkey FROM part JOIN t USING (p_brand) WHERE p_retailprice >= least")
def fdr_filter(spark, sf):
    """Of each brand, what scores at least as much as rank n - floor(n / 10); ties stay."""
    w = W.partitionBy("p_brand")
    ranked = table(spark, sf, "part").select("p_partkey", "p_brand", "p_retailprice", F.row_number().over(w.orderBy(F.desc("p_retailprice"), "p_partkey")).alias("r"), F.count("*").over(w).alias("n"))
    least = F.min(F.when(F.col("r") <= F.col("n") - F.floor(F.col("n") * 0.1), F.col("p_retailprice"))).over(w)
    return ranked.withColumn("least", least).where("p_retailprice >= least").select("p_partkey")


@query("""SELECT l_returnflag, round(avg(l_linenumber / 25.0::DOUBLE), 6) AS chrom, round(avg(l_partkey % 1000), 4) AS pos, round(avg(('0x' || substr(md5(l_shipdate::DATE::VARCHAR), 1, 8))::BIGINT / 4294967296.0::DOUBLE), 5) AS alt FROM lineitem GROUP BY l_returnflag""")
def featurize_pool(spark, sf):
    unit = F.conv(F.substring(F.md5(F.date_format("l_shipdate", "yyyy-MM-dd").cast("binary")), 1, 8), 16, 10).cast("double") / 4294967296.0
    return table(spark, sf, "lineitem").groupBy("l_returnflag").agg(F.round(F.avg(F.col("l_linenumber") / 25.0), 6).alias("chrom"), F.round(F.avg(F.col("l_partkey") % 1000), 4).alias("pos"), F.round(F.avg(unit), 5).alias("alt"))


BOOK = "k AS (SELECT label, list_transform(range(1, 65), lambda i: list_sum(list_transform(v, lambda e: e[i]))) AS w FROM (SELECT label, list(embedding::DOUBLE[]) AS v FROM embeddings GROUP BY label))"


def _book(spark, sf):
    """Each label's bundle, an item memory of a row for each label."""
    cells = table(spark, sf, "embeddings").select("label", F.posexplode("embedding").alias("pos", "x"))
    sums = cells.groupBy("label", "pos").agg(F.sum(F.col("x").cast("double")).alias("s"))
    return sums.groupBy("label").agg(F.transform(F.sort_array(F.collect_list(F.struct("pos", "s"))), lambda x: x["s"]).alias("w"))


@query(f"WITH {BOOK} SELECT vec_id, k.label AS item, round(list_cosine_similarity(embedding::DOUBLE[], w), 5) AS score FROM embeddings e, k WHERE list_cosine_similarity(embedding::DOUBLE[], w) >= 0.1")
def unbundle(spark, sf):
    """Which items of the memory each vector is near to."""
    book = _book(spark, sf).withColumnRenamed("label", "item")
    met = table(spark, sf, "embeddings").join(F.broadcast(book), V.cosine(F.col("embedding"), F.col("w")) >= 0.1)  # a row for each label
    return met.select("vec_id", "item", F.round(V.cosine(F.col("embedding"), F.col("w")), 5).alias("score"))


@query(f"WITH {BOOK} SELECT a.label AS a, b.label AS b, round(list_sum(list_transform(range(1, 65), lambda i: a.w[i] * b.w[i])), 3) AS bound FROM k a JOIN k b ON a.label < b.label")
def cross_modal(spark, sf):
    book = _book(spark, sf)
    x, y = (book.select(F.col("label").alias(i), F.col("w").alias(f"w{i}")) for i in "ab")
    return x.join(y, F.col("a") < F.col("b")).select("a", "b", F.round(V.total(V.bound(F.col("wa"), F.col("wb"))), 3).alias("bound"))  # of labels, not of rows


@query(f"WITH {BOOK} SELECT vec_id, arg_max(k.label, list_inner_product(list_transform(range(1, 65), lambda i: e.embedding[i] * e.embedding[i]), w)) AS item FROM embeddings e, k GROUP BY vec_id")
def holo_cleanup(spark, sf):
    """The item of the memory that a vector bound with itself is nearest to."""
    book = _book(spark, sf)
    v = F.col("embedding")
    met = table(spark, sf, "embeddings").select("vec_id", V.bound(v, v).alias("v")).join(F.broadcast(book))  # a row for each label
    return met.groupBy("vec_id").agg(F.max_by("label", V.dot(F.col("v"), F.col("w"))).alias("item"))


@query("SELECT x.vec_id AS a, y.vec_id AS b, list_sum(list_transform(range(1, 65), lambda i: ((x.embedding[i] > 0) <> (y.embedding[i] > 0))::INT))::INT AS distance FROM embeddings x JOIN embeddings y ON x.vec_id % 50 = 0 AND x.vec_id <> y.vec_id")
def pairwise_hamming(spark, sf):
    """All rows against the stated queries, those of ids divisible by 50."""
    rows = table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("v"))
    return blocks.hamming_of(rows.where("id % 50 = 0"), rows)


@query("SELECT event_type, t::INT AS t, round(greatest(0, max(least(t - value * 0.5, value - t))), 4) AS height FROM events, (SELECT unnest(range(0, 500, 50)) AS t) GROUP BY event_type, t")
def landscape(spark, sf):
    """The first persistence landscape of intervals from value / 2 to value, at steps of 50."""
    each = table(spark, sf, "events").select("event_type", "value", F.explode(F.sequence(F.lit(0), F.lit(450), F.lit(50))).alias("t"))
    return each.groupBy("event_type", "t").agg(F.round(F.greatest(F.lit(0.0), F.max(F.least(F.col("t") - F.col("value") * 0.5, F.col("value") - F.col("t")))), 4).alias("height"))


@query("SELECT vec_id, (i - 1)::INT AS pos, ((e[i * 3 - 2] > 0)::INT + (coalesce(e[i * 3 - 1], 0) > 0)::INT + (coalesce(e[i * 3], 0) > 0)::INT) % 2 AS parity FROM (SELECT vec_id, embedding AS e, unnest(range(1, 23)) AS i FROM embeddings)")
def ecc_parity_vectors(spark, sf):
    """The parity of each block of three components of each vector."""
    blocks = F.transform(F.sequence(F.lit(0), F.lit(21)), lambda i: F.size(F.filter(F.slice("embedding", i * 3 + 1, F.lit(3)), lambda x: x > 0)) % 2)
    return table(spark, sf, "embeddings").select("vec_id", F.posexplode(blocks).alias("pos", "parity"))


@query("SELECT vec_id, lane::INT AS lane, b::INT AS bit, ((e[lane * 32 + b + 1]) > 0)::INT AS value FROM (SELECT vec_id, embedding AS e, unnest(range(64)) // 32 AS lane, unnest(range(64)) % 32 AS b FROM embeddings)")
def unpack_bits(spark, sf):
    """Packed signs, lowest bit first, back to single bits."""
    from .records import pack_bits

    bit = F.transform(F.sequence(F.lit(0), F.lit(31)), lambda i: F.call_function("getbit", F.col("bits"), i).cast("int"))
    return pack_bits(spark, sf).select("vec_id", "lane", F.posexplode(bit).alias("bit", "value"))


def _spans_sql(kinds: dict[str, str], source: str, flags: str = "") -> str:
    """Each match's place from the pieces between matches, kind by kind."""
    one = """SELECT *, {i} AS place, '{k}' AS kind, unnest(range(1, len(v) + 1)) AS j FROM (SELECT *, regexp_extract_all(t, '{f}{p}') AS v, string_split_regex(t, '{f}{p}') AS b FROM {s})"""
    every = " UNION ALL ".join(one.format(i=i, k=k, p=_quoted(p), f=flags, s=source) for i, (k, p) in enumerate(kinds.items()))
    return f"SELECT * EXCLUDE (v, b, j), v[j] AS value, (list_sum(list_transform(b[1:j], lambda x: length(x))) + coalesce(list_sum(list_transform(v[1:j - 1], lambda x: length(x))), 0))::INT AS start FROM ({every})"


PII_SPANS = f"t AS (SELECT doc_id, text AS t FROM documents WHERE text IS NOT NULL), m AS ({_spans_sql(redaction.PII, 't')}), spans AS (SELECT doc_id, t, kind, value, start, start + length(value)::INT AS stop, row_number() OVER (PARTITION BY doc_id ORDER BY start, length(value) DESC, place) AS i FROM m)"

#: One step a span: it stays unless it begins within the last that stayed.
PII_FOLD = f"""{PII_SPANS}, fold AS (
  SELECT doc_id, t, 0::BIGINT AS i, 0 AS pos, '' AS masked, '' AS tokens FROM (SELECT DISTINCT doc_id, t FROM spans)
  UNION ALL
  SELECT f.doc_id, f.t, s.i, CASE WHEN start >= pos THEN stop ELSE pos END, CASE WHEN start >= pos THEN masked || substr(f.t, pos + 1, start - pos) || '[' || upper(kind) || ']' ELSE masked END,
    CASE WHEN start >= pos THEN tokens || substr(f.t, pos + 1, start - pos) || 'tok_' || substr(sha256(unhex('{bytes(x ^ 0x5C for x in b"testsecret".ljust(64, chr(0).encode())).hex()}') || unhex(sha256(unhex('{bytes(x ^ 0x36 for x in b"testsecret".ljust(64, chr(0).encode())).hex()}') || encode(kind || ':' || value)))), 1, 16) ELSE tokens END
  FROM fold f JOIN spans s ON s.doc_id = f.doc_id AND s.i = f.i + 1
), ended AS (SELECT doc_id, masked || substr(t, pos + 1) AS masked, tokens || substr(t, pos + 1) AS tokens FROM fold QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY i DESC) = 1)"""


@query(f"WITH {PII_SPANS} SELECT doc_id, kind, start, stop FROM spans")
def pii_spans(spark, sf):
    """Every span of every kind, overlapping ones too."""
    found = table(spark, sf, "documents").select("doc_id", F.explode(redaction.pii_spans(F.col("text"))).alias("m"))
    return found.select("doc_id", "m.kind", "m.start", F.col("m.end").alias("stop"))


def _rewritten(spark, sf, put):
    """Only texts that hold a span are rewritten."""
    some = table(spark, sf, "documents").where(F.col("text").rlike("(?U)" + "|".join(redaction.PII.values())))
    return some.select("doc_id", F.md5(put(F.col("text")).cast("binary")).alias("text_md5"))


@query(f"WITH RECURSIVE {PII_FOLD} SELECT doc_id, md5(masked) AS text_md5 FROM ended")
def pii_masked_text(spark, sf):
    return _rewritten(spark, sf, redaction.pii_masked)


@query(f"WITH RECURSIVE {PII_FOLD} SELECT doc_id, md5(tokens) AS text_md5 FROM ended")
def pii_tokenized_text(spark, sf):
    return _rewritten(spark, sf, lambda text: redaction.pii_tokenized(text, b"testsecret"))


PHI_LINES = "l AS (SELECT doc_id, unnest(range(1, len(w) + 1))::INT AS line, unnest(w) AS t FROM (SELECT doc_id, string_split(text, chr(10)) AS w FROM documents))"
#: The ten kinds, and two of one's own.
OWN_KINDS = {"ip": (redaction.PII["ipv4"], "low"), "email": (redaction.PII["email"], "medium")}
PHI_EVERY = redaction.PHI_KINDS | OWN_KINDS
PHI_CONTEXT = " + ".join(f"regexp_matches(t, '(?i){p}')::INT" for p in redaction.CONTEXT.values())
PHI_LEVEL = "CASE kind " + " ".join(f"WHEN '{k}' THEN '{s}'" for k, (_, s) in PHI_EVERY.items()) + " END"


@query(f"""WITH {PHI_LINES}, m AS ({_spans_sql({k: p for k, (p, _) in PHI_EVERY.items()}, 'l', '(?i)')}), g AS (SELECT *, {PHI_LEVEL} AS level, {PHI_CONTEXT} AS n FROM m WHERE kind <> 'gene_variant' OR length(value) <= 10)
SELECT doc_id, line, start AS "column", kind, CASE WHEN n >= 2 AND level = 'low' THEN 'medium' WHEN n >= 2 AND level = 'medium' THEN 'high' ELSE level END AS severity, n AS indicators FROM g""")
def phi_findings(spark, sf):
    """All kinds, by line, with what the line's words make of them."""
    found = redaction.phi_findings(table(spark, sf, "documents"), "doc_id", "text", OWN_KINDS)
    return found.select("doc_id", "line", "column", "kind", "severity", F.size("indicators").alias("indicators"))
