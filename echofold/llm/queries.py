"""The queries of this package: one opN_<name> for each operator, over its whole table."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import brown, jaccard, licenses, neighbours, quality, secrets, tokens, urls, warc


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_suffix_repetition(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = quality.repetition_rules(table(spark, sf_dir, "documents"), max_longest=100)
    return found.withColumn("over_long_repeat", F.col("longest_repeat") > 100).drop("longest_repeat")


def op2_secret_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan_secrets(table(spark, sf_dir, "documents"))


def op3_warc_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    return warc.warc_round_trip(pages).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "ok")


#: (verdict, host, path)
URL_RULES = [("block", "com", "/en/"), ("allow", "example.com", "/en/7"), ("allow", "net", "/de/"), ("block", "example.net", "/de/8"), ("block", "org", "/es/")]


def op4_url_digests(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.filter_urls(table(spark, sf_dir, "pages").select("page_id", "url"), URL_RULES)


def op5_jaccard_tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.jaccard_components(table(spark, sf_dir, "documents"), k=3, percent=90)


WORD_BPE = "word_bpe_49k.json"


def op6_bpe_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.bpe_round_trip(table(spark, sf_dir, "documents"), public_tokenizers.path(WORD_BPE), leaf=16)


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.pack_power_of_two(table(spark, sf_dir, "documents"), public_tokenizers.path(WORD_BPE), joined=False)


def op8_prefix_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.nearest(table(spark, sf_dir, "embeddings"))


def op9_license_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan_licenses(table(spark, sf_dir, "documents"))


def op10_brown_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return brown.score_texts(table(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (op1_suffix_repetition, op2_secret_forest, op3_warc_segments, op4_url_digests, op5_jaccard_tiles, op6_bpe_tree, op7_packing, op8_prefix_forest, op9_license_phrases, op10_brown_classes)}

#: Words and their repeats: a window that occurs twice in a text covers its places.
_OP1 = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT r, doc_id, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws FROM d),
k(n) AS (VALUES (3), (10), (101)),
p AS (SELECT r, n, unnest(range(greatest(len(ws) - n + 1, 0))) AS i, ws FROM w, k),
g AS (SELECT r, n, i, array_to_string(ws[i + 1 : i + n], ' ') AS s FROM p),
twice AS (SELECT r, n, i FROM (SELECT r, n, i, count(*) OVER (PARTITION BY r, n, s) AS c FROM g) WHERE c > 1),
places AS (SELECT DISTINCT r, n, unnest(range(i, i + n)) AS i FROM twice),
covered AS (SELECT r, count(*) FILTER (n = 3) AS c3, count(*) FILTER (n = 10) AS c10, count(*) FILTER (n = 101) AS c101 FROM places GROUP BY r),
lines AS (SELECT r, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM d),
f AS (SELECT w.r, doc_id, len(ws) AS n_words, length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g')) AS word_chars, length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS n_symbols,
  len(ls) - len(list_distinct(ls)) AS n_dup_lines, coalesce(c3, 0) AS n_repeat_words, coalesce(c10, 0) AS covered_words, coalesce(c101, 0) > 0 AS over_long_repeat
  FROM w JOIN lines USING (r) LEFT JOIN covered USING (r)),
b AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM f)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, covered_words, over_long_repeat,
  NOT base_failed AND covered_words <= CAST(0.3 AS DOUBLE) * n_words AND NOT over_long_repeat AS kept
FROM b"""

_OP5 = r"""
WITH RECURSIVE w AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
g AS (SELECT r, doc_id, CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 3 THEN [array_to_string(ws, ' ')]
  ELSE list_distinct(list_transform(range(1, len(ws) - 1), lambda i: array_to_string(ws[i : i + 2], ' '))) END AS gs FROM w),
s AS (SELECT r, len(gs) AS n, unnest(gs) AS s FROM g),
links AS (SELECT a.r AS a, b.r AS b FROM s a JOIN s b ON a.s = b.s AND a.r <> b.r GROUP BY a.r, b.r, a.n, b.n HAVING 100 * count(*) >= 90 * (a.n + b.n - count(*))),
reach(r, x) AS (SELECT r, r FROM g UNION SELECT reach.r, links.b FROM reach JOIN links ON reach.x = links.a)
SELECT g.doc_id, len(any_value(g.gs)) AS n_shingles, min(h.doc_id) AS component_id
FROM g JOIN reach USING (r) JOIN g h ON h.r = reach.x GROUP BY g.r, g.doc_id"""

ORACLE: dict[str, str] = {
    "op1_suffix_repetition": _OP1,
    "op5_jaccard_tiles": _OP5,
    "op3_warc_segments": """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS b FROM pages),
q AS (SELECT page_id, b, min(page_id) OVER (PARTITION BY b) AS f FROM p),
h AS (SELECT *, unhex(sha1(b)) AS d FROM q)
SELECT page_id, octet_length(b) AS payload_bytes,
  array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + CAST(substr(list_aggregate(list_transform(range(1, 41), lambda j: right('0000' || bin(CAST('0x' || substr(hex(d), CAST(j AS INT), 1) AS INT)), 4)), 'string_agg', ''), CAST(1 + 5 * i AS INT), 1) AS INT) * 16
    + CAST(substr(list_aggregate(list_transform(range(1, 41), lambda j: right('0000' || bin(CAST('0x' || substr(hex(d), CAST(j AS INT), 1) AS INT)), 4)), 'string_agg', ''), CAST(2 + 5 * i AS INT), 1) AS INT) * 8
    + CAST(substr(list_aggregate(list_transform(range(1, 41), lambda j: right('0000' || bin(CAST('0x' || substr(hex(d), CAST(j AS INT), 1) AS INT)), 4)), 'string_agg', ''), CAST(3 + 5 * i AS INT), 1) AS INT) * 4
    + CAST(substr(list_aggregate(list_transform(range(1, 41), lambda j: right('0000' || bin(CAST('0x' || substr(hex(d), CAST(j AS INT), 1) AS INT)), 4)), 'string_agg', ''), CAST(4 + 5 * i AS INT), 1) AS INT) * 2
    + CAST(substr(list_aggregate(list_transform(range(1, 41), lambda j: right('0000' || bin(CAST('0x' || substr(hex(d), CAST(j AS INT), 1) AS INT)), 4)), 'string_agg', ''), CAST(5 + 5 * i AS INT), 1) AS INT), 1)), '') AS payload_digest,
  CASE WHEN page_id = f THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id = f THEN NULL ELSE f END AS refers_to, true AS ok
FROM h""",
    "op4_url_digests": r"""
WITH r(rule, host0, path0, v) AS (VALUES ('com/en/', 'com', '/en/', 'block'), ('example.com/en/7', 'example.com', '/en/7', 'allow'), ('net/de/', 'net', '/de/', 'allow'), ('example.net/de/8', 'example.net', '/de/8', 'block'), ('org/es/', 'org', '/es/', 'block')),
u AS (SELECT page_id, lower(coalesce(regexp_extract(url, '://([^/?#]*)', 1), '')) AS host, coalesce(regexp_extract(url, '://[^/?#]*([^?#]*)', 1), '') AS path FROM pages)
SELECT page_id, host, path, (SELECT max_by(rule, length(rule)) FROM r WHERE (host = host0 OR ends_with(host, '.' || host0)) AND starts_with(path, path0)) AS rule,
  coalesce((SELECT max_by(v, length(rule)) FROM r WHERE (host = host0 OR ends_with(host, '.' || host0)) AND starts_with(path, path0)), 'allow') AS verdict
FROM u""",
}
