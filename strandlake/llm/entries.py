"""The subpackage's queries, over whole tables with production parameters, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .chaining import repeated_passages
from .grammars import KINDS, secret_spans
from .jaccard import jaccard_components
from .mixing import mix_sources
from .multi_index import nearest
from .ranked import ranked_search
from .repair import repaired_after_damage
from .sharding import pack_shards
from .site_templates import main_texts
from .suffix_tree import suffix_tree_scores
from .tiling import decontaminate
from .token_counts import token_counts
from .toxicity import toxicity_scores


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shards 0 to 23 under the bytes law: equal texts together, sizes near equal."""
    packed = pack_shards(table(spark, sf_dir, "documents"))
    return packed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "n_tokens")


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(table(spark, sf_dir, "documents"))


def op3_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(table(spark, sf_dir, "embeddings"))


def op4_suffix_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_tree_scores(table(spark, sf_dir, "documents"))


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per document and benchmark item whose words it holds."""
    return decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op6_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(table(spark, sf_dir, "documents"), words=4, percent=85).select("doc_id", "n_shingles", "component_id")


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op8_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per passage that a document shares with an earlier one."""
    return repeated_passages(table(spark, sf_dir, "documents"))


def op9_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secret_spans(table(spark, sf_dir, "documents"))
    written = lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))
    of = lambda kind: lambda x: x["kind"] == kind
    base = F.filter("spans", lambda x: x["kind"] != "format")
    return found.select(
        "doc_id",
        *(F.size(F.filter("spans", of(k))).cast("long").alias(f"n_{k}") for k in KINDS[:3]),
        F.sha2(F.array_join(F.transform(base, written), ","), 256).alias("base_sha256"),
        F.array_join(F.transform("spans", written), ",").alias("spans"),
        F.round(F.array_min("likelihoods"), 6).alias("least_likelihood"),
    )


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per document, in training order, those that are left out last."""
    mixed = mix_sources(table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "source", "size", "source_size", "target", "taken", F.round(F.get("positions", F.lit(0)), 6).alias("first_position"), F.size("positions").alias("passes"))


def op11_ranked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best documents for each benchmark item."""
    return ranked_search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op12_main_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return main_texts(table(spark, sf_dir, "pages"))


def op13_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repaired_after_damage(table(spark, sf_dir, "conversations"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    own = [op1_shards, op2_token_counts, op3_nearest, op4_suffix_tree, op5_decontamination, op6_jaccard, op7_toxicity, op8_passages, op9_secrets, op10_mixing, op11_ranked, op12_main_texts, op13_repair, pipeline]
    return {f.__name__: f for f in own}


OP6_SQL = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), s AS (
  SELECT DISTINCT doc_id, CASE WHEN len(w) < 4 THEN array_to_string(w, ' ') ELSE array_to_string(w[i : i + 3], ' ') END AS g
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 1) + 1)) AS i FROM d WHERE len(w) > 0)
), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id
), pairs AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL
), links AS (
  SELECT a, b FROM pairs JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 85 * (x.n + y.n - c)
), way AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links
), reach AS (SELECT doc_id, doc_id AS r FROM d UNION SELECT reach.doc_id, b FROM reach JOIN way ON reach.r = way.a)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, c.component_id
FROM d LEFT JOIN n USING (doc_id) JOIN (SELECT doc_id, min(r) AS component_id FROM reach GROUP BY doc_id) c USING (doc_id)
"""

OP10_SQL = r"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size, md5(concat('17:', coalesce(CAST(doc_id AS VARCHAR), ''))) AS key FROM documents
), s AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY source IS NULL, CAST(source AS BLOB)) - 1 AS place FROM d GROUP BY source
), w AS (SELECT *, CAST([5, 2, 1][place % 3 + 1] AS DOUBLE) AS weight, CAST([-0.5, 0, 0.5][place % 3 + 1] AS DOUBLE) AS slope, 2.0::DOUBLE * source_size AS cap FROM s
), l AS (
  SELECT *, cap / weight AS ratio, (1.5::DOUBLE * sum(source_size) OVER () - coalesce(sum(cap) OVER (ORDER BY cap / weight, place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
    / sum(weight) OVER (ORDER BY cap / weight, place ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM w
), t AS (
  SELECT *, coalesce(least(cap, weight * (SELECT level FROM l WHERE level <= ratio ORDER BY ratio, place LIMIT 1)), cap) AS target FROM l
), p AS (
  SELECT d.*, t.source_size, t.target, t.slope, floor(t.target)::BIGINT AS due,
    coalesce(sum(size) OVER (PARTITION BY d.source ORDER BY key, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS b
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source
), q AS (SELECT *, greatest(0, least(size, due - b)) AS t1, greatest(0, least(size, due - source_size - b)) AS t2 FROM p
), r AS (SELECT *, CASE WHEN t1 > 0 THEN b WHEN t2 > 0 THEN source_size + b END / target AS x FROM q)
SELECT doc_id, source, CAST(size AS BIGINT) AS size, source_size, target, CAST(t1 + t2 AS BIGINT) AS taken,
  round(CASE WHEN slope = 0 THEN x ELSE (sqrt((1 - slope) * (1 - slope) + 4 * slope * x) - (1 - slope)) / (2 * slope) END, 6) AS first_position,
  CAST((t1 > 0)::INT + (t2 > 0)::INT AS INT) AS passes
FROM r
"""


OP11_SQL = r"""
WITH words AS (
  SELECT doc_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
  FROM documents
), tf AS (SELECT doc_id, term, count(*) AS tf FROM words GROUP BY ALL
), n AS (SELECT doc_id, sum(tf)::BIGINT AS n FROM tf GROUP BY doc_id
), whole AS (SELECT count(*) AS nn, sum(n)::BIGINT AS l FROM n
), w AS (SELECT term, floor(1000 * ln((2 * nn + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE))::BIGINT AS w FROM tf, whole GROUP BY term, nn
), items AS (
  SELECT item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
  FROM benchmark
), asked AS (SELECT item_id, term, count(*) AS times FROM items GROUP BY ALL
), scores AS (
  SELECT item_id, doc_id, sum(times * w * ((1000000000 * tf) // (1000 * tf + 8 * (25 + (75 * n * nn) // l))))::BIGINT AS score
  FROM asked JOIN tf USING (term) JOIN w USING (term) JOIN n USING (doc_id), whole GROUP BY item_id, doc_id
)
SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INT AS rank, doc_id, score FROM scores WHERE score > 0
QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) <= 10
"""

OP13_SQL = r"""
WITH RECURSIVE bits AS (
  SELECT i AS b, i::BIGINT AS c, 0 AS k FROM range(256) r(i)
  UNION ALL SELECT b, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, k + 1 FROM bits WHERE k < 8
), crc AS (SELECT list(c ORDER BY b) AS t FROM bits WHERE k = 8
), fates AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
    xor(list_reduce(list_prepend(4294967295, list_transform(string_split(concat(coalesce(conv_id::VARCHAR, ' '), ':', coalesce(turn::VARCHAR, ' ')), ''), lambda x: ascii(x)::BIGINT)),
      lambda c, x: xor(c >> 8, t[(xor(c, x) & 255) + 1])), 4294967295) % 20 AS fate
  FROM conversations, crc
), rows0 AS (
  SELECT conv_id, turn, CASE WHEN fate = 4 THEN 'user' ELSE role END AS role,
    CASE fate WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text, unnest(CASE WHEN fate = 3 THEN [1, 2] ELSE [1] END) AS copy
  FROM fates WHERE fate <> 0
), rows1 AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) AS seen, rtrim(text, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS body
  FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, md5(text), copy) AS i FROM rows0)
), flags AS (
  SELECT *, left(role, 1) AS r, CASE WHEN body = '' THEN 'blank' WHEN seen > 1 THEN 'duplicate' WHEN right(body, 1) NOT IN ('.', '!', '?') THEN 'truncated' ELSE '' END AS fault,
    lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY i) || left(role, 1) AS pair FROM rows1
), edits AS (
  SELECT conv_id, i, fault IN ('blank', 'duplicate') AS bad, CASE WHEN fault = 'truncated' THEN 5 ELSE 0 END AS more, r, role, text FROM flags
), dp AS (
  SELECT conv_id, 0::BIGINT AS i, {'c': 0, 'a': '', 't': []::VARCHAR[]} AS z, {'c': 999999, 'a': '', 't': []::VARCHAR[]} AS s, {'c': 999999, 'a': '', 't': []::VARCHAR[]} AS u, {'c': 999999, 'a': '', 't': []::VARCHAR[]} AS e
  FROM (SELECT DISTINCT conv_id FROM edits)
  UNION ALL
  SELECT d.conv_id, d.i + 1,
    {'c': z.c + 2, 'a': z.a || 'D', 't': z.t},
    list_sort([{'c': s.c + 2, 'a': s.a || 'D', 't': s.t}, CASE WHEN r = 's' AND NOT bad THEN {'c': z.c + more, 'a': z.a || 'K', 't': list_append(z.t, role || ':' || text)} ELSE {'c': 999999, 'a': '', 't': []::VARCHAR[]} END])[1],
    list_sort(list_concat([{'c': u.c + 2, 'a': u.a || 'D', 't': u.t}], CASE WHEN bad THEN [] ELSE list_transform(
      [z, s, e, {'c': u.c + 5, 'a': u.a || 'I', 't': list_append(u.t, 'assistant:')}], lambda p: {'c': p.c + more + (r <> 'u')::INT, 'a': p.a || CASE WHEN r = 'u' THEN 'K' ELSE 'R' END, 't': list_append(p.t, CASE WHEN r = 'u' THEN role ELSE 'user' END || ':' || text)}) END))[1],
    list_sort(list_concat([{'c': e.c + 2, 'a': e.a || 'D', 't': e.t}], CASE WHEN bad THEN [] ELSE list_transform(
      list_concat([u], list_transform([z, s, e], lambda p: {'c': p.c + 5, 'a': p.a || 'I', 't': list_append(p.t, 'user:')})), lambda p: {'c': p.c + more + (r <> 'a')::INT, 'a': p.a || CASE WHEN r = 'a' THEN 'K' ELSE 'R' END, 't': list_append(p.t, CASE WHEN r = 'a' THEN role ELSE 'assistant' END || ':' || text)}) END))[1]
  FROM dp d JOIN edits x ON x.conv_id IS NOT DISTINCT FROM d.conv_id AND x.i = d.i + 1
), best AS (
  SELECT conv_id, list_sort([z, e, {'c': u.c + 5, 'a': u.a || 'I', 't': list_append(u.t, 'assistant:')}, {'c': s.c + 10, 'a': s.a || 'II', 't': list_concat(s.t, ['user:', 'assistant:'])}])[1] AS b
  FROM dp JOIN (SELECT conv_id AS k, max(i) AS n FROM edits GROUP BY ALL) ON k IS NOT DISTINCT FROM conv_id AND n = i
), counts AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate,
    count(*) FILTER (fault = 'truncated') AS truncated, count(*) FILTER (pair NOT IN ('su', 'ua', 'au')) AS illegal FROM flags GROUP BY conv_id
)
SELECT o.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate, coalesce(truncated, 0)::BIGINT AS truncated, coalesce(illegal, 0)::BIGINT AS illegal,
  coalesce(b.c, 0)::BIGINT AS cost, coalesce(b.a, '') AS audit, sha256(coalesce(array_to_string(b.t, chr(10)), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) o LEFT JOIN counts ON counts.conv_id IS NOT DISTINCT FROM o.conv_id LEFT JOIN best ON best.conv_id IS NOT DISTINCT FROM o.conv_id
"""


def oracle_sql() -> dict[str, str]:
    return {"op6_jaccard": OP6_SQL, "op10_mixing": OP10_SQL, "op11_ranked": OP11_SQL, "op13_repair": OP13_SQL}
