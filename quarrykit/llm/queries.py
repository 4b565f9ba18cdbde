"""The registered queries of the training-data operators, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontaminate, jaccard, language, mixing, nearest, pii, secrets, sharding, suffix, toxicity


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_suffix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes of every document inside 100-byte strings that start earlier."""
    return suffix.dedup(_table(spark, sf_dir, "documents"), texts=False).drop("kept")


def op2_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Class and number of links of every document at a shingle similarity of 0.8."""
    return jaccard.join(_table(spark, sf_dir, "documents"))


def op3_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document, learned from two thirds of the labelled ones."""
    docs = _table(spark, sf_dir, "documents")
    held_out = language.held_out(F.col("doc_id"))
    model = language.fit(docs.where(~held_out))
    return language.identify(docs, model).select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of every document inside benchmark windows."""
    return decontaminate.report(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every document, learned from four fifths of the labels."""
    docs, labels = _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels")
    held_out = toxicity.held_out(F.col("doc_id"))
    model = toxicity.fit(docs, labels.where(~held_out))
    return toxicity.score(docs, model).select("doc_id", held_out.alias("held_out"), "score", "predicted")


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raked weight, probability and draw of every document."""
    return mixing.weigh(_table(spark, sf_dir, "documents"))


def op7_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest vectors of every twentieth one."""
    return nearest.search(_table(spark, sf_dir, "embeddings"))


def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data in every document."""
    return pii.report(_table(spark, sf_dir, "documents"))


def op9_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets in every document, each different text scanned once."""
    return secrets.report(_table(spark, sf_dir, "documents"))


def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in shards 0 to 7 of nearly equal bytes."""
    out = sharding.shard(_table(spark, sf_dir, "documents"), shards=8)
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


#: Words as op4's contract has them; windows of 8, or of a whole shorter item.
OP4_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents),
b AS (SELECT CAST(item_id AS VARCHAR) AS item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM benchmark),
bp AS (SELECT item_id, ws, least(8, len(ws)) AS n, unnest(generate_series(1, len(ws) - least(8, len(ws)) + 1)) AS i FROM b WHERE len(ws) > 0),
w AS (SELECT DISTINCT item_id, n, array_to_string(ws[i:i + n - 1], ' ') AS win FROM bp),
sizes AS (SELECT DISTINCT n FROM w),
dp AS (SELECT doc_id, ws, unnest(generate_series(1, len(ws))) AS i FROM d),
hits AS (SELECT doc_id, i, w.n, item_id FROM (SELECT doc_id, i, n, array_to_string(ws[i:i + n - 1], ' ') AS win FROM dp CROSS JOIN sizes WHERE i + n - 1 <= len(ws)) p JOIN w ON p.n = w.n AND p.win = w.win),
pos AS (SELECT doc_id, count(DISTINCT q) AS n_hit FROM (SELECT doc_id, unnest(generate_series(i, i + n - 1)) AS q FROM hits) GROUP BY doc_id),
its AS (SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS ids FROM (SELECT DISTINCT doc_id, item_id FROM hits) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.ws) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_items, 0) >= 2 AS contaminated
FROM d LEFT JOIN pos ON pos.doc_id = d.doc_id LEFT JOIN its ON its.doc_id = d.doc_id
"""


#: Shingle sets, their overlaps by shared shingle, and reachability over links.
OP2_SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents),
x AS (SELECT DISTINCT doc_id, array_to_string(ws[i:i + 4], ' ') AS g FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 3, 2))) AS i FROM w WHERE len(ws) > 0)),
n AS (SELECT doc_id, count(*) AS n, string_agg(g, '|' ORDER BY g) AS sh FROM x GROUP BY 1),
s AS (SELECT w.doc_id, t, coalesce(n, 0) AS n, sh FROM w LEFT JOIN n ON n.doc_id = w.doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM x a JOIN x b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM p JOIN s sa ON sa.doc_id = a JOIN s sb ON sb.doc_id = b WHERE c >= 0.8 * (sa.n + sb.n - c) - 1e-9
      UNION ALL SELECT a.doc_id, b.doc_id FROM s a JOIN s b ON a.t = b.t AND a.doc_id <> b.doc_id WHERE a.n = 0 AND a.t <> ''),
r AS (SELECT a, b FROM l UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a),
e AS (SELECT doc_id, CASE WHEN n > 0 THEN 's' || sh WHEN t <> '' THEN 't' || t ELSE 'd' || CAST(doc_id AS VARCHAR) END AS k FROM s)
SELECT e.doc_id, least(e.doc_id, coalesce((SELECT min(b) FROM r WHERE r.a = e.doc_id), e.doc_id)) AS class_id, min(e.doc_id) OVER (PARTITION BY k) AS set_id,
       (SELECT count(*) FROM l WHERE l.a = e.doc_id) AS n_links FROM e
"""


#: Texts as hexadecimal bytes; starts of repeated 100-byte strings, joined to spans, and the bytes between the spans.
OP1_SQL = """
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
w AS (SELECT doc_id, p, substr(h, 2 * p + 1, 200) AS s FROM (SELECT doc_id, h, unnest(range(0, length(h) // 2 - 99)) AS p FROM d)),
r AS (SELECT doc_id, p FROM (SELECT doc_id, p, row_number() OVER (PARTITION BY s ORDER BY doc_id, p) AS k FROM w) WHERE k > 1),
g AS (SELECT doc_id, p, sum(fresh) OVER (PARTITION BY doc_id ORDER BY p) AS g FROM (SELECT doc_id, p, CASE WHEN p - lag(p) OVER (PARTITION BY doc_id ORDER BY p) <= 100 THEN 0 ELSE 1 END AS fresh FROM r)),
s AS (SELECT doc_id, min(p) AS a, max(p) + 100 AS z FROM g GROUP BY doc_id, g),
b AS (SELECT doc_id, a, z, coalesce(lag(z) OVER (PARTITION BY doc_id ORDER BY a), 0) AS y FROM s),
k AS (SELECT b.doc_id, count(*) AS n_spans, sum(z - a) AS n_removed, string_agg(substr(h, 2 * y + 1, 2 * (a - y)), '' ORDER BY a) || any_value(substr(h, 2 * e + 1)) AS kept
      FROM b JOIN d ON d.doc_id = b.doc_id JOIN (SELECT doc_id, max(z) AS e FROM s GROUP BY 1) m ON m.doc_id = b.doc_id GROUP BY 1)
SELECT d.doc_id, CAST(length(h) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, CAST(coalesce(n_spans, 0) AS BIGINT) AS n_spans, sha256(unhex(coalesce(kept, h))) AS kept_sha256
FROM d LEFT JOIN k ON k.doc_id = d.doc_id
"""


def _op9_sql() -> str:
    """Hits and the gaps between them give the positions, rule by rule."""
    assign = r"""(?i:password|passwd|secret|token|api_?key)["'']?\x20*[:=]\x20*["'']?"""
    rules = (("assign", assign + "[A-Za-z0-9+/_.=-]+"), ("access", secrets.ACCESS), ("hex", secrets.HEX), ("pem", secrets.PEM), ("forge", secrets.FORGE), ("jwt", secrets.JWT))
    every = " UNION ALL ".join(f"SELECT doc_id, {i} AS rank, '{n}' AS kind, regexp_extract_all(t, '{p}') AS hits, regexp_split_to_array(t, '{p}') AS gaps FROM d" for i, (n, p) in enumerate(rules))
    one = "kind || ':' || CAST(a AS VARCHAR) || ':' || CAST(a + length(hit) AS VARCHAR)"
    return f"""WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents), k AS ({every}),
e AS (SELECT doc_id, rank, kind, unnest(range(1, len(hits) + 1)) AS i, hits, gaps FROM k),
s AS (SELECT doc_id, rank, kind, hits[i] AS hit, CAST(list_sum(list_transform(gaps[1:i], lambda g: length(g))) + coalesce(list_sum(list_transform(hits[1:i - 1], lambda h: length(h))), 0) AS BIGINT) AS a FROM e),
v AS (SELECT * FROM s WHERE kind <> 'assign' OR regexp_full_match(hit, '{assign}[A-Za-z0-9+/_.=-]{{8,}}')),
b AS (SELECT doc_id, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access, count(*) FILTER (kind = 'hex') AS n_hex,
      string_agg({one}, ',' ORDER BY a, rank) FILTER (rank < 3) AS base, string_agg({one}, ',' ORDER BY a, rank) AS spans FROM v GROUP BY 1)
SELECT d.doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans FROM d LEFT JOIN b ON b.doc_id = d.doc_id"""


def queries() -> dict:
    return {"op1_suffix": op1_suffix, "op2_jaccard": op2_jaccard, "op3_language": op3_language, "op4_decontamination": op4_decontamination, "op5_toxicity": op5_toxicity, "op6_mixing": op6_mixing, "op7_nearest": op7_nearest, "op8_pii": op8_pii, "op9_secrets": op9_secrets, "op10_sharding": op10_sharding}


def oracle_sql() -> dict:
    return {"op1_suffix": OP1_SQL, "op2_jaccard": OP2_SQL, "op4_decontamination": OP4_SQL, "op9_secrets": _op9_sql()}
