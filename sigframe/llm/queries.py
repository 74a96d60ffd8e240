"""One query for each operator of this subpackage, with production parameters over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import centroid_clustering, exact_dedup, filter_audit, license_scan, mixing, packing, pii_surrogates, quality_classifier, quality_rules, simhash_dedup, token_output, topk_search, url_filter


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan(table(spark, sf_dir, "documents")).drop("text", "spans").withColumn("score", F.round("score", 6))


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"))


def op3_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_classifier.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op5_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk_search.search(table(spark, sf_dir, "embeddings"))


def op6_pii_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii_surrogates.replace(table(spark, sf_dir, "documents").select("doc_id", "text"), count="n_replaced")


def op7_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_output.token_output(table(spark, sf_dir, "documents"))


def op8_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_dedup.near_components(table(spark, sf_dir, "documents"))


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).withColumn("target", F.round("target", 6))


def op10_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return url_filter.judge(pages, listed=url_filter.production_list(pages)).drop("listed")


def op11_centroid_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    return centroid_clustering.clustered(table(spark, sf_dir, "embeddings"))


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op13_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_groups(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = [
        op1_license_scan, op2_packing, op3_quality_classifier, op4_quality_rules, op5_topk_search, op6_pii_surrogates, op7_token_output, op8_simhash_dedup,
        op9_mixing, op10_url_filter, op11_centroid_clustering, op12_filter_audit, op13_exact_dedup,
    ]
    return {f.__name__: f for f in found}


OP5_SQL = """WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS DOUBLE)) AS q FROM embeddings WHERE embedding IS NOT NULL AND list_count(embedding) = len(embedding) AND len(list_filter(embedding, lambda x: NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS query_id, b.vec_id, CAST(list_dot_product(a.q, b.q) AS BIGINT) AS score FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE a.vec_id % 20 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 20"""

def _op1_sql() -> str:
    """The same votes, diagonals and spans; words stand in place of hashes."""
    quoted = lambda x: "'" + x + "'"
    runs = license_scan.template_runs(license_scan.PHRASES, [*license_scan.NOTICES, *license_scan.TEXTS])
    known = ", ".join(f"({i}, {quoted(label)}, {phrase}, {q}, {length}, {k}, {quoted(' '.join(run))})" for i, label, phrase, q, length, k, run in runs)
    return rf"""WITH k(template, label, phrase, q, length, k, run) AS (VALUES {known}),
d AS (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{license_scan.WORD}') AS w FROM documents),
x AS (SELECT rid, w, unnest(range(len(w))) AS p FROM d),
r AS (SELECT rid, p, 2 AS k, w[p + 1] || ' ' || w[p + 2] AS run FROM x WHERE p + 2 <= len(w) UNION ALL SELECT rid, p, 3, w[p + 1] || ' ' || w[p + 2] || ' ' || w[p + 3] FROM x WHERE p + 3 <= len(w)),
v AS (SELECT r.rid, template, label, phrase, length, k.k, r.p - q AS diagonal, list(DISTINCT q) AS qs FROM r JOIN k ON r.k = k.k AND r.run = k.run GROUP BY ALL),
f AS (SELECT *, CASE WHEN diagonal - lag(diagonal) OVER (PARTITION BY rid, template ORDER BY diagonal) <= {license_scan.DRIFT} THEN 0 ELSE 1 END AS fresh FROM v),
m AS (SELECT *, sum(fresh) OVER (PARTITION BY rid, template ORDER BY diagonal) AS span, len(qs) = length - k + 1 AS whole FROM f),
c AS (SELECT rid, template, span, count(DISTINCT q + j) AS covered FROM (SELECT rid, template, span, k, unnest(qs) AS q FROM m) AS y, range(3) AS g(j) WHERE j < k GROUP BY ALL),
s AS (SELECT m.rid, m.template, label, phrase, m.span, count(*) FILTER (whole) AS exact, min(diagonal) FILTER (whole) AS lo, max(diagonal) FILTER (whole) AS hi,
  any_value(covered) / any_value(length) AS share, max(diagonal + list_max(qs) + k) - min(diagonal + list_min(qs)) AS wide, any_value(length) AS length
  FROM m JOIN c ON m.rid = c.rid AND m.template = c.template AND m.span = c.span GROUP BY m.rid, m.template, label, phrase, m.span),
t AS (SELECT *, phrase AND exact > 0 AS base, exact > 0 OR (NOT phrase AND share >= {license_scan.COVERED} AND wide <= {license_scan.STRETCH} * length) AS good FROM s)
SELECT doc_id, CAST(len(any_value(w)) AS BIGINT) AS n_words, CAST(coalesce(sum(exact) FILTER (base), 0) AS BIGINT) AS n_base, CAST(min(lo) FILTER (base) AS BIGINT) AS first_word, CAST(max(hi) FILTER (base) AS BIGINT) AS last_word,
  coalesce(string_agg(DISTINCT label, ',' ORDER BY label) FILTER (base), '') AS base_labels, coalesce(string_agg(DISTINCT label, ',' ORDER BY label) FILTER (good), '') AS labels, round(coalesce(max(share) FILTER (good), 0.0), 6) AS score
FROM d LEFT JOIN t USING (rid) GROUP BY rid, doc_id"""


OP9_SQL = """WITH d AS (SELECT doc_id, coalesce(text, '') AS t, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS size FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
w AS (SELECT *, [3.0, 1.0, 2.0][(row_number() OVER (ORDER BY source IS NULL, source) - 1) % 3 + 1]::DOUBLE AS w, 2.0::DOUBLE * source_size AS most FROM s),
f AS (SELECT *, (sum(source_size) OVER () * 1.5::DOUBLE - coalesce(sum(most) OVER (ORDER BY most / w, source IS NULL, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
  / sum(w) OVER (ORDER BY most / w, source IS NULL, source ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM w),
g AS (SELECT *, coalesce(max(CASE WHEN level <= most / w THEN level END) OVER (), 'inf'::DOUBLE) AS lev FROM f),
a AS (SELECT source, source_size, least(w * lev, most) AS target FROM g),
b AS (SELECT *, floor(CASE WHEN source_size > 0 THEN target / source_size ELSE 0 END + 1e-12) AS copies FROM a),
r AS (SELECT *, CAST(round(greatest(0, target - copies * source_size)) AS BIGINT) AS rest FROM b),
e AS (SELECT d.*, (size >> greatest(length(bin(size)) - 7, 0)) << greatest(length(bin(size)) - 7, 0) AS m,
  (CAST(CAST('0x' || substr(md5(concat_ws('|', '9', coalesce(CAST(doc_id AS VARCHAR), ''), t)), 1, 13) AS UBIGINT) AS DOUBLE) + 0.5) / 4503599627370496.0::DOUBLE AS u FROM d),
k AS (SELECT source, m, sum(size) AS w FROM e WHERE size > 0 GROUP BY 1, 2),
v AS (SELECT k.source, k.m, r.rest, coalesce(sum(k.w) OVER (PARTITION BY k.source ORDER BY k.m DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS above,
  sum(k.m * k.w) OVER (PARTITION BY k.source ORDER BY k.m DESC ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS tail FROM k JOIN r ON k.source IS NOT DISTINCT FROM r.source WHERE r.rest > 0),
x AS (SELECT source, max(m) AS most, arg_max(CAST(rest - above AS DOUBLE) / tail, m) AS c, arg_max(above, m) AS above FROM v WHERE CAST(rest - above AS DOUBLE) / tail * m <= 1 GROUP BY source),
j AS (SELECT e.doc_id, e.t, e.size, e.u, r.source, r.source_size, r.target, r.copies, r.rest - coalesce(x.above, 0) AS rest, coalesce(e.size > 0 AND e.m > x.most, false) AS certain,
  CASE WHEN e.size > 0 AND x.c * e.m > 0 THEN (e.u / (1 - e.u)) / (x.c * e.m / greatest(1 - x.c * e.m, 1e-15)) ELSE 1e30 END AS q
  FROM e JOIN r ON e.source IS NOT DISTINCT FROM r.source LEFT JOIN x ON e.source IS NOT DISTINCT FROM x.source),
o AS (SELECT *, coalesce(sum(CASE WHEN certain THEN 0 ELSE size END) OVER (PARTITION BY source ORDER BY q, u, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM j)
SELECT doc_id, size, source_size, round(target, 6) AS target, CAST(copies * size + CASE WHEN certain THEN size ELSE greatest(0, least(size, rest - before)) END AS BIGINT) AS taken FROM o"""

OP10_SQL = """WITH u AS (SELECT page_id, url, html, instr(url, '://') AS pos FROM pages), r AS (SELECT page_id, html, CASE WHEN pos > 0 THEN substr(url, pos + 3) ELSE '' END AS rest FROM u),
p AS (SELECT page_id, html, translate(regexp_extract(rest, '^[^/?#]*', 0), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM r),
n AS (SELECT page_id, coalesce(host, '') AS host, coalesce(path, '') AS path, html FROM p),
z AS (SELECT DISTINCT host || regexp_replace(path, '/$', '') AS canonical FROM n WHERE host IN ('spam-farm.example.com', 'spam-farm.example.net', 'spam-farm.example.org')
  OR (contains(html, '<article>') AND length(regexp_replace(regexp_extract(html, '<article>(.*?)</article>', 1, 's'), '<[^>]*>', '', 'g')) < 200)),
k(rule, rhost, rpath, v) AS (VALUES ('org/', 'org', '/', 'allow'), ('example.org/es/', 'example.org', '/es/', 'block'), ('example.org/en/1', 'example.org', '/en/1', 'block'), ('com/fr/', 'com', '/fr/', 'allow'), ('com/de/', 'com', '/de/', 'block')),
m AS (SELECT n.*, k.rule, k.v, row_number() OVER (PARTITION BY page_id ORDER BY length(k.rule) DESC NULLS LAST) AS i FROM n LEFT JOIN k ON (n.host = k.rhost OR ends_with(n.host, '.' || k.rhost)) AND starts_with(n.path, k.rpath))
SELECT page_id, host, path, rule, coalesce(v, CASE WHEN host || regexp_replace(path, '/$', '') IN (SELECT canonical FROM z) THEN 'block' ELSE 'allow' END) AS verdict FROM m WHERE i = 1"""


def _op11_sql() -> str:
    """Every distance in every round; a list of CTEs, two for each round."""
    c = centroid_clustering
    fine = f"len(embedding) = {c.DIMS} AND list_count(embedding) = {c.DIMS} AND len(list_filter(embedding, lambda x: NOT isfinite(x))) = 0"
    q = f"list_transform(embedding, lambda x: CAST(floor({c.SCALE} * CAST(x AS DOUBLE)) AS BIGINT))"
    hashed = f"sha256('{c.SALT}:' || CAST(vec_id AS VARCHAR))"
    parts = [
        f"v AS MATERIALIZED (SELECT row_number() OVER () AS rid, vec_id, {q} AS q FROM embeddings WHERE {fine})",
        f"c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY {hashed} NULLS LAST, q) - 1 AS c, q FROM v QUALIFY c < {c.K})",
    ]
    square = "CAST(list_sum(list_transform(list_zip(v.q, k.q), lambda p: (p[1] - p[2]) * (p[1] - p[2]))) AS BIGINT)"
    for i in range(c.ROUNDS + 1):
        parts.append(f"a{i} AS MATERIALIZED (SELECT rid, any_value(vec_id) AS vec_id, any_value(v.q) AS q, min(struct_pack(d := {square}, c := k.c)) AS m FROM v, c{i} AS k GROUP BY rid)")
        if i < c.ROUNDS:
            sums = f"SELECT m.c AS c, dim, sum(q[dim]) AS s, count(*) AS n FROM a{i}, range(1, {c.DIMS + 1}) AS g(dim) GROUP BY m.c, dim"
            means = f"SELECT c, list(CAST((s - ((s % n) + n) % n) // n AS BIGINT) ORDER BY dim) AS q FROM ({sums}) GROUP BY c"
            parts.append(f"c{i + 1} AS MATERIALIZED ({means} UNION ALL SELECT c, q FROM c{i} WHERE c NOT IN (SELECT m.c FROM a{i}))")
    last = f"a{c.ROUNDS}"
    return (
        f"WITH {', '.join(parts)} SELECT vec_id, CAST(m.c AS INTEGER) AS cluster, m.d AS distance, CAST(sum(m.d) OVER (PARTITION BY m.c) AS BIGINT) AS cluster_inertia, "
        f"CAST(sum(m.d) OVER () AS BIGINT) AS inertia, sha256(array_to_string(k.q, ',')) AS centroid_sha256 FROM {last} JOIN c{c.ROUNDS} AS k ON m.c = k.c"
    )


OP12_SQL = """WITH l AS (SELECT doc_id, bool_or(quality = 1) AS good, bool_or(toxic = 1) AS toxic FROM labels WHERE doc_id IS NOT NULL GROUP BY doc_id),
d AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t FROM documents),
w AS (SELECT *, regexp_extract_all(t, '[^\\x20\\x09-\\x0D]+') AS ws, min(doc_id) OVER (PARTITION BY t) AS first_id FROM d),
f AS (SELECT w.*, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic, CAST(len(ws) < 200 AS INT) + 2 * CAST(100 * len(list_distinct(ws)) < 50 * len(ws) AS INT)
  + 4 * CAST(100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 3 * length(t) AS INT) + 8 * CAST(regexp_matches(t, '[#$%&*|]') AS INT) + 16 * CAST(coalesce(first_id < w.doc_id, false) AS INT) AS mask
  FROM w LEFT JOIN l ON w.doc_id = l.doc_id),
m AS (SELECT part, mask, count(*) AS n, count(*) FILTER (good) AS g, count(*) FILTER (toxic) AS x FROM f GROUP BY part, mask),
r AS (SELECT i FROM range(5) AS t(i)),
p AS (SELECT [a.i, b.i, c.i, d.i, e.i] AS o FROM r AS a, r AS b, r AS c, r AS d, r AS e WHERE len(list_distinct([a.i, b.i, c.i, d.i, e.i])) = 5),
s AS (SELECT array_to_string(list_transform(o, lambda i: substr('ABCDE', CAST(i + 1 AS INT), 1)), '') AS filter_order, CAST(step AS INTEGER) AS step, CAST(1 << o[step] AS INT) AS bit,
  CAST(coalesce(list_sum(list_transform(o[1:step - 1], lambda i: CAST(1 << i AS INT))), 0) AS INT) AS before FROM p, range(1, 6) AS t(step)),
y AS (SELECT part, filter_order, step, bit, CAST(coalesce(sum(n) FILTER ((mask & (before | bit)) = 0), 0) AS BIGINT) AS kept,
  CAST(coalesce(sum(n) FILTER ((mask & before) = 0 AND (mask & bit) <> 0), 0) AS BIGINT) AS removed,
  CAST(coalesce(sum(n) FILTER ((mask & before) <> 0 AND (mask & bit) <> 0), 0) AS BIGINT) AS redundant, CAST(coalesce(sum(n) FILTER (mask = bit), 0) AS BIGINT) AS unique_fails,
  CAST(coalesce(sum(g) FILTER ((mask & before) = 0 AND (mask & bit) <> 0), 0) AS BIGINT) AS good_lost, CAST(coalesce(sum(x) FILTER ((mask & before) = 0 AND (mask & bit) <> 0), 0) AS BIGINT) AS toxic_lost
  FROM m, s GROUP BY part, filter_order, step, bit)
SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, CAST(sum(removed) OVER (PARTITION BY part, bit) AS BIGINT) AS shapley FROM y"""

OP13_SQL = """WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents)
SELECT doc_id, max(doc_id) OVER (PARTITION BY t) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size, row_number() OVER (PARTITION BY t ORDER BY doc_id DESC NULLS LAST) = 1 AS kept, sha256(t) AS text_sha256 FROM d"""


def oracle_sql() -> dict[str, str]:
    """SQL for the same rows. The others tokenize, train, draw or hash as SQL cannot; the tests hold them against plain versions."""
    return {
        "op1_license_scan": _op1_sql(), "op5_topk_search": OP5_SQL, "op9_mixing": OP9_SQL, "op10_url_filter": OP10_SQL,
        "op11_centroid_clustering": _op11_sql(), "op12_filter_audit": OP12_SQL, "op13_exact_dedup": OP13_SQL,
    }
