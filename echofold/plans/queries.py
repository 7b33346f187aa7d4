"""Named queries over the test tables, each with SQL that states the same result where SQL can."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import names as N
from ..functions.hashes import word_grams
from ..operators import clones, idioms, pairs, peers, records
from ..operators.graph import _cut


def _t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def _parts(spark, d):
    """Parts as functions: name, file (brand), line (key)."""
    return _t(spark, d, "part").select(F.col("p_name").alias("name"), F.col("p_brand").alias("file"), F.col("p_partkey").alias("line"))


def _flat(p: DataFrame) -> DataFrame:
    return p.select(F.col("a.file").alias("a_file"), F.col("a.line").alias("a_line"), F.col("a.name").alias("a_name"), F.col("b.file").alias("b_file"), F.col("b.line").alias("b_line"), F.col("b.name").alias("b_name"), "tier")


def exact_name_pairs(spark, d):
    return _flat(pairs.exact_name_pairs(_parts(spark, d)))


def _word_names(spark, d):
    """Each capitalisation of a word of the documents as a function of its own: the language is the file."""
    found = F.array_distinct(F.regexp_extract_all("text", F.lit("([A-Za-z]+)"), F.lit(1)))
    return _t(spark, d, "documents").select(F.explode(found).alias("name"), F.col("lang").alias("file"), F.lit(1).alias("line")).distinct()


def normalised_name_pairs(spark, d):
    """Tier 2 alone, counted by normalised name: words that differ in case only, in two languages."""
    p = pairs.normalised_name_pairs(_word_names(spark, d)).where("a.name <> b.name")
    return p.groupBy(N.normalised(F.col("a.name")).alias("key")).agg(F.count(F.lit(1)).alias("pairs"))


def near_name_pairs(spark, d):
    return _flat(pairs.near_name_pairs(_parts(spark, d)))


def _ignored(spark, d) -> tuple[str, ...]:
    """The two most frequent part names stand for names that recur by convention."""
    return tuple(r.p_name for r in _t(spark, d, "part").groupBy("p_name").count().orderBy(F.desc("count"), "p_name").limit(2).collect())


def tier_counts(spark, d):
    return pairs.tier_counts(pairs.counted_tiers(_parts(spark, d), _ignored(spark, d)))


def ignored_breakdown(spark, d):
    return pairs.ignored_breakdown(pairs.counted_tiers(_parts(spark, d), _ignored(spark, d)))


def name_words(spark, d):
    names = _t(spark, d, "part").select(F.col("p_name").alias("name")).union(_t(spark, d, "events").select("event_type")).distinct()
    w = N.name_words(F.col("name"))
    return names.select("name", F.array_join(w, "|").alias("words"), F.array_join(N.without_affixes(w), "|").alias("stem"), N.set_key(N.without_affixes(w)).alias("set_key"))


def _bodied_parts(spark, d):
    """Parts as functions with bodies: the words of name and type."""
    body = F.array_distinct(F.split(F.lower(F.concat_ws(" ", "p_name", "p_type")), "\\s+"))
    return _t(spark, d, "part").select(F.col("p_name").alias("name"), F.col("p_brand").alias("file"), F.col("p_partkey").alias("line"), F.col("p_size").alias("size"), body.alias("shape_set"))


def evidence_status(spark, d):
    """Body evidence of exact-name part pairs."""
    e = pairs.exact_evidence(_bodied_parts(spark, d))
    return e.select(F.col("a.line").alias("a_line"), F.col("b.line").alias("b_line"), "status", "sim", "examined", "size_ratio")


def evidence_counts(spark, d):
    return pairs.evidence_counts(pairs.counted_exact_evidence(_bodied_parts(spark, d)))


def exact_duplicate_docs(spark, d):
    docs = _t(spark, d, "documents")
    return docs.groupBy(F.md5("text").alias("digest")).agg(F.count(F.lit(1)).alias("copies"), F.min("doc_id").alias("first_doc"), F.count_distinct("source").alias("sources")).where("copies > 1")


def _bodies(spark, d):
    docs = _t(spark, d, "documents")
    return docs.select(F.col("doc_id").alias("id"), F.col("lang").alias("name"), F.col("source").alias("file"), F.col("doc_id").alias("line"), F.col("doc_id").alias("end_line"), clones.text_words(F.col("text")).alias("words")).withColumn("size", F.size("words"))


def doc_shingles(spark, d):
    b = _bodies(spark, d)
    return b.select(F.col("id").alias("doc_id"), F.size("words").cast("bigint").alias("n_words"), F.size(word_grams(F.col("words"), 5)).cast("bigint").alias("n_shingles"))


def doc_minhash(spark, d):
    s = clones.signed(_bodies(spark, d))
    return s.select(F.col("id").alias("doc_id"), F.col("n_shingles").alias("n_shingles"), F.array_join("sig", ",").alias("sig"))


def lsh_candidates(spark, d):
    return clones.lsh_candidates(_cut(clones.lsh_buckets(clones.signed(_bodies(spark, d)).select("id", "sig"))))


def near_duplicate_pairs(spark, d):
    s = _cut(clones.signed(_bodies(spark, d)).select("id", "shingles", "n_shingles", "sig"))
    p = clones.judged_pairs(clones.lsh_candidates(clones.lsh_buckets(s), None), s, 0.7)
    return p.where("verdict = 'accepted'").select("a", "b", N.half_up(F.col("sim"), 2).alias("sim"))


def near_duplicate_clusters(spark, d):
    c = clones.body_clones(_bodies(spark, d), min_body=5).clusters
    return c.select("cluster_id", F.size("members").alias("n_members"), "files", "copies", "size", "min_sim", "same_name")


def clone_counters(spark, d):
    return clones.body_clones(_bodies(spark, d), min_body=40).stats


def repeated_lines(spark, d):
    lines = _t(spark, d, "documents").select("doc_id", F.explode(F.array_distinct(F.split("text", "\n"))).alias("line"))
    return lines.groupBy("line").agg(F.count(F.lit(1)).alias("docs")).where("docs >= 3")


def _words(spark, d):
    return _t(spark, d, "documents").select(F.col("doc_id").alias("d"), clones.text_words(F.col("text")).alias("words"))


def token_document_frequency(spark, d):
    return idioms.document_frequency(_words(spark, d), "words")


def token_idf(spark, d):
    docs = _words(spark, d)
    n = docs.agg(F.count(F.lit(1)).alias("n"))
    freq = idioms.document_frequency(docs, "words").crossJoin(F.broadcast(n))  # one row
    return freq.select("name", F.round(idioms.idf(F.col("n"), F.col("df")), 6).alias("idf"))


def repeated_windows(spark, d):
    docs = _words(spark, d).withColumnRenamed("words", "norm")
    return idioms.recurring_windows(docs, 16, 3).select(F.col("key").alias("digest"), "files")


def _idiom_docs(spark, d):
    """Documents as token streams: every word kept, words of 8 letters or more as names, lines by number."""
    w = _t(spark, d, "documents").select(F.col("doc_id").alias("d"), clones.text_words(F.col("text")).alias("words"), F.col("source").alias("file"))
    names = F.transform("words", lambda x: F.when(F.length(x) >= 8, x))
    return w.select(F.col("d").cast("int").alias("d"), F.format_string("%s/%08d", "file", F.col("d")).alias("file"), F.col("words").alias("norm"), names.alias("names"), F.transform("words", lambda x, i: i + 1).alias("lines"))


def idiom_ranking(spark, d):
    return idioms.find_idioms(_idiom_docs(spark, d)).runs.select("rank", "files", "tokens", "info", "file", "line", "end_line", "verdict")


def idiom_counters(spark, d):
    return idioms.find_idioms(_idiom_docs(spark, d)).stats


def benchmark_overlap(spark, d):
    grams = lambda t, k: _t(spark, d, t).select(F.col(k), F.explode(word_grams(clones.text_words(F.col("text")), 5)).alias("g"))
    hits = grams("documents", "doc_id").join(grams("benchmark", "item_id"), "g")
    return hits.groupBy("doc_id", "item_id").agg(F.count(F.lit(1)).alias("windows"))


def _flows(spark, d):
    """Monthly trade between nations as sockets: the supplier's nation is local, the customer's remote; the port tells month and half of the nations."""
    l = _t(spark, d, "lineitem").select("l_orderkey", "l_suppkey", (F.year("l_shipdate") * 12 + F.month("l_shipdate")).alias("m"))
    o = _t(spark, d, "orders").select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_custkey").alias("c_custkey"))
    c = _t(spark, d, "customer").select("c_custkey", F.col("c_nationkey").alias("remote"))
    s = _t(spark, d, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), F.col("s_nationkey").alias("local"))
    flow = l.join(o, "l_orderkey").join(c, "c_custkey").join(s, "l_suppkey").select("local", "remote", "m").distinct()
    n = lambda c: F.format_string("n%02d", c)
    port = lambda c: (F.col("m") * 2 + F.col(c) % 2).cast("int")
    name = F.concat_ws("-", n(F.col("local")), n(F.col("remote")), F.col("m").cast("string"))
    return flow.select((F.col("m") * 10000 + F.col("local") * 100 + F.col("remote")).alias("seq"), n(F.col("local")).alias("local_ip"), port("local").alias("local_port"), n(F.col("remote")).alias("remote_ip"), port("remote").alias("remote_port"), F.lit("ESTABLISHED").alias("state"), name.alias("inode"))


def _summary(spark, d):
    flows = _flows(spark, d)
    owners = flows.select("inode", F.substring("inode", 2, 2).cast("int").alias("pid"), F.substring("inode", 1, 3).alias("comm"))
    listen = flows.where("local_port % 2 = 0").select(F.col("local_port").alias("port")).distinct()
    return peers.summarise(peers.pair_connections(flows), owners, listen, threshold=2)


def peer_pairs(spark, d):
    return peers.pair_connections(_flows(spark, d)).select("inode", "peer_inode")


def peer_asymmetry(spark, d):
    return _summary(spark, d).processes


def peer_connections(spark, d):
    return _summary(spark, d).pairs


def peer_totals(spark, d):
    return _summary(spark, d).totals


def journal_last_event(spark, d):
    e = _t(spark, d, "events").select("user_id", F.col("event_type").alias("event"), "event_id", "ts")
    return records.last_event(e.withColumn("seq", F.struct("ts", "event_id")), by=["user_id"]).select("user_id", "event", "event_id")


def journal_status_counts(spark, d):
    return records.event_counts(_t(spark, d, "events").select(F.col("event_type").alias("event")))


def _days(spark, d):
    return _t(spark, d, "events").select("user_id", F.to_date("ts").cast("string").alias("day"), F.col("event_type").alias("event"))


def journal_gated(spark, d):
    e = _days(spark, d)
    return records.gated(e.select("user_id", "day").distinct(), e, ["user_id", "day"], F.col("event") == "purchase")


def journal_ungated(spark, d):
    e = _days(spark, d)
    return records.ungated(e.select("user_id", "day").distinct(), e, ["user_id", "day"], F.col("event") == "purchase")


def claims_stale(spark, d):
    """Orders that claim to be finished though a line is open."""
    claims = _t(spark, d, "orders").where("o_orderstatus = 'F'").select("o_orderkey", "o_orderdate")
    still = _t(spark, d, "lineitem").where("l_linestatus = 'O'").select(F.col("l_orderkey").alias("o_orderkey")).distinct()
    return claims.join(still, "o_orderkey", "left_semi").select("o_orderkey")


def claims_without_facts(spark, d):
    return _t(spark, d, "orders").select("o_orderkey").join(_t(spark, d, "lineitem").select(F.col("l_orderkey").alias("o_orderkey")), "o_orderkey", "left_anti")


def unlabelled_inventory(spark, d):
    return records.inventory_changes(_t(spark, d, "documents"), _t(spark, d, "labels"), "doc_id").groupBy("change").agg(F.count(F.lit(1)).alias("docs"))


def props_parsed(spark, d):
    e = _t(spark, d, "events")
    return e.select("event_id", F.json_object_keys("props").alias("k"), "props").select("event_id", F.size("k").cast("bigint").alias("n_keys"), F.get_json_object("props", "$.k").alias("v"))


def top_pairs(spark, d):
    """The 60 first exact pairs in order, as reports show them."""
    return _flat(pairs.first_exact_pairs(_parts(spark, d), 60)).orderBy("a_file", "a_line", "a_name", "b_file", "b_line")


def first_wins(spark, d):
    """The first customer of each segment and nation by key, as owner tables keep the first owner."""
    w = Window.partitionBy("c_mktsegment", "c_nationkey").orderBy("c_custkey")
    return _t(spark, d, "customer").withColumn("n", F.row_number().over(w)).where("n = 1").select("c_mktsegment", "c_nationkey", "c_custkey")


QUERIES = {f.__name__: f for f in (
    exact_name_pairs, normalised_name_pairs, near_name_pairs, tier_counts, ignored_breakdown, name_words, evidence_status, evidence_counts,
    exact_duplicate_docs, doc_shingles, doc_minhash, lsh_candidates, near_duplicate_pairs, near_duplicate_clusters, clone_counters, repeated_lines,
    token_document_frequency, token_idf, repeated_windows, idiom_ranking, idiom_counters, benchmark_overlap,
    peer_pairs, peer_asymmetry, peer_connections, peer_totals, journal_last_event, journal_status_counts, journal_gated, journal_ungated,
    claims_stale, claims_without_facts, unlabelled_inventory, props_parsed, top_pairs, first_wins,
)}

_WORDS = r"list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[ \t\n\x0B\f\r]+'), lambda w: w <> '')"
_GRAMS = "list_transform(range(1, greatest(len(w) - 3, 1)), lambda i: array_to_string(w[i:i+4], ' '))"
_PAIRS = "SELECT a.p_brand AS a_file, a.p_partkey AS a_line, a.p_name AS a_name, b.p_brand AS b_file, b.p_partkey AS b_line, b.p_name AS b_name"
_ORDERED = "a.p_brand < b.p_brand"
_NEAR = """stem AS (SELECT DISTINCT p_name, string_split(p_name, ' ') AS w FROM part),
near AS (SELECT p.p_name AS p, q.p_name AS q FROM stem p JOIN stem q ON p.p_name <> q.p_name AND (list_sort(list_distinct(p.w)) = list_sort(list_distinct(q.w)) OR levenshtein(array_to_string(p.w, ''), array_to_string(q.w, '')) <= 2))"""
_TIERS = f"""WITH {_NEAR}, top AS (SELECT p_name FROM part GROUP BY 1 ORDER BY count(*) DESC, p_name LIMIT 2),
pairs AS ({_PAIRS}, 1 AS tier FROM part a JOIN part b ON a.p_name = b.p_name AND {_ORDERED}
UNION ALL {_PAIRS}, 3 FROM part a JOIN near ON a.p_name = p JOIN part b ON b.p_name = q AND {_ORDERED}),
t AS (SELECT *, a_name IN (SELECT p_name FROM top) AND b_name IN (SELECT p_name FROM top) AS ign FROM pairs)"""
_FLOWS = """flow AS (SELECT DISTINCT s_nationkey AS l, c_nationkey AS r, year(l_shipdate) * 12 + month(l_shipdate) AS m FROM lineitem JOIN orders ON o_orderkey = l_orderkey JOIN customer ON c_custkey = o_custkey JOIN supplier ON s_suppkey = l_suppkey),
ends AS (SELECT f.l, f.r, f.m, format('n{:02d}-n{:02d}-{}', f.l, f.r, f.m) AS inode, CASE WHEN g.l IS NULL THEN NULL ELSE format('n{:02d}-n{:02d}-{}', g.l, g.r, g.m) END AS peer_inode, f.l % 2 = 0 AS serves FROM flow f LEFT JOIN flow g ON g.l = f.r AND g.r = f.l AND g.m = f.m)"""
_DAYS = "days AS (SELECT user_id, strftime(ts, '%Y-%m-%d') AS day, bool_or(event_type = 'purchase') AS bought FROM events GROUP BY ALL)"


def _signed_sql(least: int = 5) -> str:
    """Bodies of at least so many words, their distinct hashed 5-grams, MinHash values and band buckets."""
    return f"""
body AS (SELECT doc_id, lang, source, {_WORDS} AS w FROM documents),
own AS (SELECT doc_id, unnest({_GRAMS}) AS g FROM body WHERE len(w) >= {max(least, 5)}),
code AS (SELECT g, list_transform(string_split(g, ''), lambda c: CAST(unicode(c) AS UBIGINT)) AS cs FROM (SELECT DISTINCT g FROM own)),
hashed AS (SELECT g, list_reduce(list_prepend(CAST(2166136261 AS UBIGINT), cs), lambda x, y: (xor(x, y) * CAST(16777619 AS UBIGINT)) & CAST(4294967295 AS UBIGINT)) AS h FROM code),
grams AS (SELECT DISTINCT doc_id, h FROM own JOIN hashed USING (g)),
n AS (SELECT doc_id, count(*) AS n FROM grams GROUP BY 1),
m0 AS (SELECT doc_id, i, xor(h, CAST((i * 2654435761) & 4294967295 AS UBIGINT)) AS x FROM grams, range(1, 65) r(i)),
m1 AS (SELECT doc_id, i, (xor(x, x >> 16) * CAST(2246822507 AS UBIGINT)) & CAST(4294967295 AS UBIGINT) AS x FROM m0),
m2 AS (SELECT doc_id, i, (xor(x, x >> 13) * CAST(3266489909 AS UBIGINT)) & CAST(4294967295 AS UBIGINT) AS x FROM m1),
sig AS MATERIALIZED (SELECT doc_id, i, min(xor(x, x >> 16)) AS m FROM m2 GROUP BY 1, 2),
bucket AS MATERIALIZED (SELECT doc_id, (i - 1) // 4 AS band, string_agg(CAST(m AS VARCHAR), ',' ORDER BY i) AS b FROM sig GROUP BY 1, 2),
sized AS (SELECT band, b, count(*) AS members FROM bucket GROUP BY 1, 2 HAVING count(*) > 1)"""


def _judged_sql(least: int = 5, largest: int | None = 60) -> str:
    few = "" if largest is None else f" WHERE members <= {largest}"
    return f"""{_signed_sql(least)},
few AS (SELECT doc_id, band, b FROM bucket JOIN sized USING (band, b){few}),
near AS MATERIALIZED (SELECT DISTINCT x.doc_id AS a, y.doc_id AS b FROM few x JOIN few y USING (band, b) WHERE x.doc_id < y.doc_id),
shared AS (SELECT a, b, count(*) AS common FROM near JOIN grams x ON x.doc_id = a JOIN grams y ON y.doc_id = near.b AND y.h = x.h GROUP BY 1, 2),
judged AS MATERIALIZED (SELECT a, near.b, least(x.n, y.n) / greatest(x.n, y.n) AS ratio, coalesce(common, 0) / (x.n + y.n - coalesce(common, 0)) AS sim
  FROM near JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = near.b LEFT JOIN shared USING (a, b))"""


_CLUSTERS = f"""WITH RECURSIVE {_judged_sql()},
links AS (SELECT a, b FROM judged WHERE ratio >= 0.7 AND sim >= 0.7),
ways AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach(x, y) AS (SELECT DISTINCT a, a FROM ways UNION SELECT x, b FROM reach JOIN ways ON y = a),
root AS (SELECT x AS doc_id, min(y) AS root FROM reach GROUP BY 1),
least AS (SELECT root, min(sim) AS s FROM judged JOIN root ON doc_id = a WHERE ratio >= 0.7 AND sim >= 0.7 GROUP BY 1)
SELECT root AS cluster_id, count(*) AS n_members, count(DISTINCT source) AS files, count(*) AS copies, floor(avg(len(w)) + 0.5)::INT AS size, floor(any_value(s) * 100 + 0.5) / 100 AS min_sim, count(DISTINCT lang) = 1 AS same_name
FROM root JOIN body USING (doc_id) JOIN least USING (root) GROUP BY root"""

_CLONE_COUNTERS = f"""WITH {_judged_sql(40)},
v AS (SELECT count(*) AS candidate_pairs, CAST(0 AS BIGINT) AS nested, count(*) FILTER (ratio < 0.7) AS ruled_out_size, count(*) FILTER (ratio >= 0.7) AS verified, count(*) FILTER (ratio >= 0.7 AND sim >= 0.7) AS accepted FROM judged)
SELECT (SELECT count(*) FROM body) AS functions, (SELECT count(*) FROM body WHERE len(w) < 40) AS too_small, (SELECT count(*) FROM n) AS signed, (SELECT count(*) FROM sized) AS buckets, (SELECT count(*) FROM sized WHERE members > 60) AS oversize_buckets, v.* FROM v"""

#: The words of a name: a blank at each boundary, one kind of boundary after the other.
_NAME_WORDS = r"""
WITH names AS (SELECT p_name AS name FROM part UNION SELECT event_type FROM events),
cut AS (SELECT name, regexp_replace(regexp_replace(regexp_replace(regexp_replace(name, '([a-z0-9])([A-Z])', '\1 \2', 'g'), '([A-Z])([A-Z][a-z])', '\1 \2', 'g'), '([A-Za-z])([0-9])', '\1 \2', 'g'), '([0-9])([A-Za-z])', '\1 \2', 'g') AS c FROM names),
w AS (SELECT name, list_transform(regexp_extract_all(c, '[^_$\s]+'), lambda x: lower(x)) AS ws FROM cut),
k AS (SELECT name, ws, list_filter(range(1, len(ws) + 1), lambda i: NOT list_contains({AFFIXES}, ws[i])) AS kept FROM w),
s AS (SELECT name, ws, CASE WHEN len(ws) = 0 THEN ws WHEN len(kept) = 0 THEN ws[-1:] ELSE ws[kept[1] : kept[-1]] END AS st FROM k)
SELECT name, array_to_string(ws, '|') AS words, array_to_string(st, '|') AS stem, array_to_string(list_sort(list_distinct(st)), '|') AS set_key FROM s""".replace("{AFFIXES}", str(list(N.AFFIXES)))

#: The smaller word list is walked in order until the outcome is sure.
_EVIDENCE = f"""
WITH body AS (SELECT p_partkey AS line, p_name, p_brand, p_size AS size, list_filter(regexp_split_to_array(lower(concat_ws(' ', p_name, p_type)), '\\s+'), lambda x: true) AS raw FROM part),
first AS (SELECT line, p_name, p_brand, size, list_filter(raw, lambda x, i: list_position(raw, x) = i) AS s FROM body),
p AS (SELECT a.line AS a_line, b.line AS b_line, CASE WHEN len(b.s) < len(a.s) THEN b.s ELSE a.s END AS small, CASE WHEN len(b.s) < len(a.s) THEN a.s ELSE b.s END AS large, len(a.s) + len(b.s) AS total,
  CASE WHEN greatest(a.size, b.size) = 0 THEN 0.0 ELSE least(a.size, b.size) / greatest(a.size, b.size) END AS ratio
  FROM first a JOIN first b ON a.p_name = b.p_name AND a.p_brand <> b.p_brand AND (a.p_brand, a.line) < (b.p_brand, b.line)),
steps AS (SELECT a_line, b_line, len(small) AS n, total, unnest(range(1, len(small) + 1)) AS k, unnest(list_transform(small, lambda x: CAST(list_contains(large, x) AS INT))) AS hit FROM p WHERE ratio >= 0.5),
walk AS (SELECT a_line, b_line, n, total, k, sum(hit) OVER (PARTITION BY a_line, b_line ORDER BY k) AS hits FROM steps),
judged AS (SELECT *, CASE WHEN (hits + n - k) / (total - (hits + n - k)) < 0.3 THEN 'ruled-out-disjoint' WHEN k < n AND hits / (total - hits) >= 0.6 THEN 'confirmed' WHEN k = n THEN 'compared' END AS e FROM walk),
done AS (SELECT a_line, b_line, arg_min(e, k) AS e, min(k) AS k, arg_min(hits / (total - hits), k) AS sim FROM judged WHERE e IS NOT NULL GROUP BY 1, 2),
evidence AS (SELECT a_line, b_line, coalesce(e, 'ruled-out-size') AS status, CASE WHEN e IN ('confirmed', 'compared') THEN floor(sim * 100 + 0.5) / 100 END AS sim, coalesce(k, 0) AS examined, floor(ratio * 100 + 0.5) / 100 AS size_ratio FROM p LEFT JOIN done USING (a_line, b_line))
"""

_COUNTS = "count(*) AS pairs, count(*) FILTER (status = 'compared') AS compared, count(*) FILTER (status = 'confirmed') AS confirmed, count(*) FILTER (status = 'ruled-out-size') AS pruned_size, count(*) FILTER (status = 'ruled-out-disjoint') AS pruned_disjoint, CAST(coalesce(sum(examined), 0) AS BIGINT) AS examined_total"

ORACLE = {
    "name_words": _NAME_WORDS,
    "evidence_status": f"{_EVIDENCE} SELECT * FROM evidence",
    "evidence_counts": f"{_EVIDENCE} SELECT {_COUNTS} FROM evidence",
    "doc_minhash": f"WITH {_signed_sql()} SELECT doc_id, n AS n_shingles, string_agg(CAST(m AS VARCHAR), ',' ORDER BY i) AS sig FROM sig JOIN n USING (doc_id) GROUP BY ALL",
    "lsh_candidates": f"WITH {_judged_sql()} SELECT a, b FROM near",
    "near_duplicate_pairs": f"WITH {_judged_sql(largest=None)} SELECT a, b, floor(sim * 100 + 0.5) / 100 AS sim FROM judged WHERE ratio >= 0.7 AND sim >= 0.7",
    "near_duplicate_clusters": _CLUSTERS,
    "clone_counters": _CLONE_COUNTERS,
    "exact_name_pairs": f"{_PAIRS}, 1 AS tier FROM part a JOIN part b ON a.p_name = b.p_name AND {_ORDERED}",
    "near_name_pairs": f"WITH {_NEAR} {_PAIRS}, 3 AS tier FROM part a JOIN near ON a.p_name = p JOIN part b ON b.p_name = q AND {_ORDERED}",
    "normalised_name_pairs": "WITH n AS (SELECT DISTINCT lang, unnest(regexp_extract_all(text, '[A-Za-z]+')) AS w FROM documents) SELECT lower(a.w) AS key, count(*) AS pairs FROM n a JOIN n b ON lower(a.w) = lower(b.w) AND a.w <> b.w AND a.lang < b.lang GROUP BY 1",
    "tier_counts": f"{_TIERS} SELECT tier, count(*) FILTER (NOT ign) AS kept, count(*) FILTER (ign) AS ignored FROM t GROUP BY 1",
    "ignored_breakdown": f"{_TIERS} SELECT CASE WHEN a_name = b_name THEN a_name ELSE a_name || ' / ' || b_name END AS label, count(*) AS pairs FROM t WHERE ign GROUP BY 1",
    "exact_duplicate_docs": "SELECT md5(text) AS digest, count(*) AS copies, min(doc_id) AS first_doc, count(DISTINCT source) AS sources FROM documents GROUP BY 1 HAVING count(*) > 1",
    "doc_shingles": f"SELECT doc_id, len(w) AS n_words, CASE WHEN len(w) < 5 THEN 0 ELSE len(list_distinct({_GRAMS})) END AS n_shingles FROM (SELECT doc_id, {_WORDS} AS w FROM documents)",
    "repeated_lines": "SELECT line, count(*) AS docs FROM (SELECT DISTINCT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents) GROUP BY 1 HAVING count(*) >= 3",
    "token_document_frequency": f"SELECT name, count(*) AS df FROM (SELECT DISTINCT doc_id, unnest({_WORDS}) AS name FROM documents) GROUP BY 1",
    "token_idf": f"SELECT name, round(log2((SELECT count(*) FROM documents) / count(*)), 6) AS idf FROM (SELECT DISTINCT doc_id, unnest({_WORDS}) AS name FROM documents) GROUP BY 1",
    "repeated_windows": f"WITH g AS (SELECT DISTINCT doc_id, unnest(list_transform(range(1, greatest(len(w) - 14, 1)), lambda i: md5(array_to_string(w[i:i+15], ' ')))) AS digest FROM (SELECT doc_id, {_WORDS} AS w FROM documents) WHERE len(w) >= 16) SELECT digest, count(*) AS files FROM g GROUP BY 1 HAVING count(*) >= 3",
    "benchmark_overlap": f"WITH a AS (SELECT DISTINCT doc_id, unnest({_GRAMS}) AS g FROM (SELECT doc_id, {_WORDS} AS w FROM documents) WHERE len(w) >= 5), b AS (SELECT DISTINCT item_id, unnest({_GRAMS}) AS g FROM (SELECT item_id, {_WORDS} AS w FROM benchmark) WHERE len(w) >= 5) SELECT doc_id, item_id, count(*) AS windows FROM a JOIN b USING (g) GROUP BY ALL",
    "peer_pairs": f"WITH {_FLOWS} SELECT inode, peer_inode FROM ends",
    "peer_asymmetry": f"WITH {_FLOWS} SELECT l AS pid, format('n{{:02d}}', l) AS comm, count(*) FILTER (NOT serves) AS client_end, count(*) FILTER (serves) AS server_end, count(*) FILTER (peer_inode IS NULL) AS external, count(*) FILTER (NOT serves) - count(*) FILTER (serves) >= 2 AND count(*) FILTER (NOT serves) >= 2 AS flagged FROM ends GROUP BY l",
    "peer_connections": f"WITH {_FLOWS}, one AS (SELECT * FROM ends WHERE peer_inode IS NOT NULL AND l <= r), sides AS (SELECT CASE WHEN serves THEN l ELSE r END AS sv, CASE WHEN serves THEN r ELSE l END AS cl, m FROM one) SELECT format('n{{:02d}}({{}}) :{{}}  <->  n{{:02d}}({{}})', sv, sv, m * 2 + sv % 2, cl, cl) AS label, count(*) AS connections FROM sides GROUP BY 1",
    "peer_totals": f"WITH {_FLOWS} SELECT count(*) AS attributed, CAST(0 AS BIGINT) AS unattributed, count(*) FILTER (peer_inode IS NULL) AS external FROM ends",
    "journal_last_event": "SELECT user_id, arg_max(event_type, (ts, event_id)) AS event, arg_max(event_id, (ts, event_id)) AS event_id FROM events GROUP BY 1",
    "journal_status_counts": "SELECT coalesce(event_type, 'malformed') AS event, count(*) AS rows FROM events GROUP BY 1",
    "journal_gated": f"WITH {_DAYS} SELECT user_id, day FROM days WHERE bought",
    "journal_ungated": f"WITH {_DAYS} SELECT user_id, day FROM days WHERE NOT bought",
    "claims_stale": "SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F' AND EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_linestatus = 'O')",
    "claims_without_facts": "SELECT o_orderkey FROM orders WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey)",
    "unlabelled_inventory": "SELECT CASE WHEN l.doc_id IS NULL THEN 'new' WHEN d.doc_id IS NULL THEN 'stale' ELSE 'same' END AS change, count(*) AS docs FROM documents d FULL JOIN labels l ON d.doc_id = l.doc_id GROUP BY 1",
    "props_parsed": "SELECT event_id, CAST(len(json_keys(props)) AS BIGINT) AS n_keys, json_extract_string(props, '$.k') AS v FROM events",
    "top_pairs": f"{_PAIRS}, 1 AS tier FROM part a JOIN part b ON a.p_name = b.p_name AND {_ORDERED} ORDER BY a_file, a_line, a_name, b_file, b_line LIMIT 60",
    "first_wins": "SELECT c_mktsegment, c_nationkey, min(c_custkey) AS c_custkey FROM customer GROUP BY ALL",
}
