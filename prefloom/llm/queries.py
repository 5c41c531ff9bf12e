"""The registered queries op1 to op10, each over its whole table, and their DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from . import decontam, langid, licenses, mixing, neardup, quality, rules, substrings, tokens, warc


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_warc_transactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.captures(_table(spark, sf_dir, "pages"))


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.quality_rules(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op3_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(_table(spark, sf_dir, "documents"), 85)


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    marked = decontam.contamination(docs, _table(spark, sf_dir, "benchmark"))
    return marked.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


def op5_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = licenses.license_scan(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", F.array_join("licenses", ",").alias("licenses"), F.size("matches").cast("long").alias("n_matches"))


def op6_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return mixing.mixed(docs).select("doc_id", "source", F.col("copy").cast("long").alias("copy"), "mix_key", "text")


def op7_token_planes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.token_table(_table(spark, sf_dir, "documents"))


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "lang", "text")
    return langid.languages(docs).select("doc_id", langid.held_out().alias("held_out"), "lang_pred", "score", "rejected")


def op9_quality_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return quality.quality(docs, _table(spark, sf_dir, "labels")).select("doc_id", langid.held_out().alias("held_out"), "score", "predicted")


def op10_repeated_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.repeated_passages(_table(spark, sf_dir, "documents")).select("doc_id", "n_words", "n_removed", "kept_sha256")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (op1_warc_transactions, op2_quality_rules, op3_minhash_dedup, op4_decontamination, op5_license_scan, op6_source_mixing, op7_token_planes, op8_language_id, op9_quality_neighbours, op10_repeated_passages)
}
_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_BLANK = r"[^\x20\x09-\x0D]+"
_ALNUM = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"

#: DuckDB SQL of the queries that SQL can express. The others are held against brute force in the tests.
ORACLE_SQL: dict[str, str] = {
    "op1_warc_transactions": """
WITH p AS (SELECT page_id, sha1(coalesce(html, '')) AS s, octet_length(encode(coalesce(html, ''))) AS n FROM pages), m AS (SELECT s, max(page_id) AS top FROM p GROUP BY s)
SELECT page_id, n::BIGINT AS payload_bytes,
  array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + ((('0x' || substr(s, (1 + 5 * (i // 4))::INT, 5))::INT >> (5 * (3 - i % 4))::INT) & 31), 1)), '') AS payload_digest,
  CASE WHEN page_id = top THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> top THEN top END AS refers_to
FROM p JOIN m USING (s)""",
    "op3_minhash_dedup": f"""
WITH RECURSIVE d AS MATERIALIZED (SELECT doc_id, regexp_extract_all({_LOWER}, '{_BLANK}') AS w FROM documents),
s AS MATERIALIZED (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')] ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) END AS g FROM d),
n AS MATERIALIZED (SELECT doc_id, len(g) AS n FROM s), u AS MATERIALIZED (SELECT doc_id, hash(x) AS h, x FROM (SELECT doc_id, unnest(g) AS x FROM s)),
k AS MATERIALIZED (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM u a JOIN u b ON a.h = b.h AND a.x = b.x AND a.doc_id < b.doc_id GROUP BY ALL),
l AS MATERIALIZED (SELECT a, b FROM k JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 85 * (x.n + y.n - c)),
e AS MATERIALIZED (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r(a, b) AS (SELECT doc_id, doc_id FROM n UNION SELECT r.a, e.b FROM r JOIN e ON e.a = r.b)
SELECT r.a AS doc_id, any_value(n.n)::BIGINT AS n_shingles, min(r.b) AS component_id, min(r.b) = r.a AS kept FROM r JOIN n ON n.doc_id = r.a GROUP BY r.a""",
    "op4_decontamination": f"""
WITH d AS MATERIALIZED (SELECT doc_id, regexp_extract_all({_LOWER}, '{_ALNUM}') AS w FROM documents),
i AS (SELECT item_id, regexp_extract_all({_LOWER}, '{_ALNUM}') AS w FROM benchmark),
j AS (SELECT item_id, w, least(13, len(w)) AS k FROM i WHERE len(w) > 0),
v AS MATERIALIZED (SELECT DISTINCT item_id, k, array_to_string(w[p:p + k - 1], ' ') AS x FROM (SELECT item_id, w, k, unnest(range(1, len(w) - k + 2)) AS p FROM j)),
o AS (SELECT doc_id, k, p, array_to_string(w[p:p + k - 1], ' ') AS x FROM (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS p FROM d, (SELECT DISTINCT k FROM j))),
h AS MATERIALIZED (SELECT doc_id, item_id, p, k FROM o JOIN v USING (k, x)),
c AS (SELECT doc_id, count(DISTINCT q) AS n_hit FROM (SELECT doc_id, unnest(range(p, p + k)) AS q FROM h) GROUP BY doc_id),
t AS (SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS ids FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item_id FROM h) GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN c USING (doc_id) LEFT JOIN t USING (doc_id)""",
    "op6_source_mixing": """
WITH n AS (SELECT source, count(*) AS docs, sqrt(count(*)) AS weight FROM documents GROUP BY source),
r AS (SELECT source, weight * sum(docs) OVER () / (sum(weight) OVER () * docs) AS rate FROM n),
d AS (SELECT doc_id, documents.source, text, greatest(ceil(rate / 8.0), 1)::INT AS parts, rate / greatest(ceil(rate / 8.0), 1) AS each FROM documents JOIN r ON documents.source IS NOT DISTINCT FROM r.source),
p AS (SELECT DISTINCT doc_id, each, unnest(range(1, parts + 1)) AS part FROM d),
u AS (SELECT *, ('0x' || substr(md5(doc_id::VARCHAR || '#' || part || '|mix-1'), 1, 13))::BIGINT / 4503599627370496.0::DOUBLE AS u FROM p),
f AS (SELECT doc_id, part, u, sum(exp(k * ln(each) - each - lgamma(k + 1))) OVER (PARTITION BY doc_id, part ORDER BY k) AS cdf FROM u, (SELECT unnest(range(0, 48)) AS k)),
c AS (SELECT doc_id, count(*) FILTER (WHERE cdf <= u) AS copies FROM f GROUP BY doc_id)
SELECT doc_id, source, copy, ('0x' || substr(md5(doc_id::VARCHAR || '|' || copy || '|mix-1-order'), 1, 15))::BIGINT AS mix_key, text
FROM (SELECT doc_id, source, text, unnest(range(1, copies + 1)) AS copy FROM d JOIN c USING (doc_id))""",
    "op10_repeated_passages": f"""
WITH d AS MATERIALIZED (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '{_BLANK}') AS w FROM documents),
o AS MATERIALIZED (SELECT doc_id, p, sha256(array_to_string(w[p:p + 34], ' ')) AS x FROM (SELECT doc_id, w, unnest(range(1, len(w) - 33)) AS p FROM d WHERE len(w) >= 35)),
t AS (SELECT x FROM o GROUP BY x HAVING count(*) > 1), g AS (SELECT DISTINCT doc_id, unnest(range(p, p + 35)) AS q FROM o JOIN t USING (x)),
k AS (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS q FROM d),
a AS (SELECT k.doc_id, string_agg(word, ' ' ORDER BY k.q) FILTER (WHERE g.q IS NULL) AS kept, count(g.q) AS n_removed FROM k LEFT JOIN g ON g.doc_id = k.doc_id AND g.q = k.q GROUP BY k.doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM d LEFT JOIN a USING (doc_id)""",
}
