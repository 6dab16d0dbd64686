"""The registered query of each operator: it runs the operator over its whole table and derives the columns asked for."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..sources.tables import table
from . import ann, language, mixing, neardup, quality, secrets, sharding, tokenizing, topk, urls

QUERIES = {}
ORACLES = {}


def register(query):
    QUERIES[query.__name__] = query
    return query


@register
def op3_feistel_shards(spark, sf_dir):
    placed = sharding.shard_documents(table(spark, sf_dir, "documents"))
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


@register
def op7_systematic_mix(spark, sf_dir):
    return mixing.mix_counts(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


ORACLES["op7_systematic_mix"] = r"""
WITH d AS (SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS size FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY 1),
w AS (SELECT *, 3 * source_size AS cap, CAST([5, 2, 1][1 + (row_number() OVER (ORDER BY source IS NULL, encode(source)) - 1) % 3] AS DOUBLE) AS weight FROM s),
l AS (SELECT *, CAST(CAST(sum(source_size) OVER () AS BIGINT) - CAST(coalesce(sum(cap) OVER (ORDER BY cap / weight, source IS NULL, encode(source) ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS DOUBLE)
  / sum(weight) OVER (ORDER BY cap / weight, source IS NULL, encode(source) ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM w),
m AS (SELECT level FROM l WHERE level * weight <= cap ORDER BY cap / weight, level LIMIT 1),
t AS (SELECT source, source_size, least(CAST(cap AS DOUBLE), coalesce((SELECT level FROM m) * weight, CAST(cap AS DOUBLE))) AS target FROM l),
k AS (SELECT d.doc_id, d.source, d.size, t.source_size, t.target, CASE WHEN t.source_size > 0 THEN t.target / t.source_size ELSE 0 END AS rate,
  row_number() OVER (PARTITION BY d.source ORDER BY d.size, d.doc_id) AS k FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
u AS (SELECT source, target, i, (CAST(('0x' || left(md5(coalesce('s' || source, 'null') || '/11/' || i), 8)) AS BIGINT) % 4096 + 0.5) / 4096 AS u FROM t, range(16) r(i)),
c AS (SELECT u.source, u.i, u.u, abs(sum(k.size * (floor(rate * k + u.u) - floor(rate * (k - 1) + u.u))) - any_value(u.target)) AS miss FROM u JOIN k ON k.source IS NOT DISTINCT FROM u.source GROUP BY ALL),
b AS (SELECT source, u FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY miss, i) AS r FROM c) WHERE r = 1)
SELECT doc_id, size, source_size, target, CAST(size * (floor(rate * k + u) - floor(rate * (k - 1) + u)) AS BIGINT) AS taken FROM k JOIN b ON k.source IS NOT DISTINCT FROM b.source"""


@register
def op8_secret_novelty(spark, sf_dir):
    found = secrets.scan_documents(table(spark, sf_dir, "documents"))
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("bigint").alias(f"n_{kind}")
    text = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    base = F.filter("spans", lambda s: s["kind"] != "novel")
    return found.select("doc_id", count("assign"), count("access"), count("hex"), F.sha2(text(base).cast("binary"), 256).alias("base_sha256"), text(F.col("spans")).alias("spans"))


@register
def op10_chunked_bpe(spark, sf_dir):
    return tokenizing.encode_documents(table(spark, sf_dir, "documents"))


@register
def op1_redirect_filter(spark, sf_dir):
    return urls.judge_pages(table(spark, sf_dir, "pages")).select("page_id", "host", "path", "rule", "verdict")


@register
def op5_collision_counting(spark, sf_dir):
    return ann.approximate_top_k(table(spark, sf_dir, "embeddings"))


@register
def op9_tiled_top_k(spark, sf_dir):
    return topk.exact_top_k(table(spark, sf_dir, "embeddings"))


ORACLES["op9_tiled_top_k"] = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS DOUBLE)) AS q FROM (SELECT DISTINCT vec_id, embedding FROM embeddings WHERE embedding IS NOT NULL)),
p AS (SELECT a.vec_id AS query_id, b.vec_id, CAST(list_dot_product(a.q, b.q) AS BIGINT) AS score FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE a.vec_id % 50 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM p)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 5"""

ORACLES["op1_redirect_filter"] = r"""
WITH RECURSIVE rules(rule, host, path, verdict) AS (VALUES ('com/en/', 'com', '/en/', 'block'), ('example.com/en/7', 'example.com', '/en/7', 'allow'), ('net/de/', 'net', '/de/', 'allow'), ('example.net/de/8', 'example.net', '/de/8', 'block'), ('org/es/', 'org', '/es/', 'block')),
tags AS (SELECT url, unnest([regexp_extract(regexp_extract(html, '(?is)<link[^>]*rel\s*=\s*["'']?\s*canonical[^>]*>'), '(?is)href\s*=\s*["'']?\s*([^"''\s>]+)', 1),
  regexp_extract(regexp_extract(html, '(?is)<meta[^>]*http-equiv\s*=\s*["'']?\s*refresh[^>]*>'), '(?is)content\s*=\s*["'']?[^"''>]*?url\s*=\s*[''"]?\s*([^"''\s>]+)', 1)]) AS raw FROM pages WHERE url IS NOT NULL AND html IS NOT NULL),
e AS (SELECT url AS a, CASE WHEN contains(t, '://') THEN t WHEN starts_with(t, '//') THEN regexp_extract(url, '^[^:/?#]*:') || t WHEN starts_with(t, '/') THEN regexp_extract(url, '^[^:/?#]*://[^/?#]*') || t END AS b FROM (SELECT url, replace(raw, '&amp;', '&') AS t FROM tags)),
both_ways AS (SELECT a, b FROM e WHERE b IS NOT NULL AND a <> b UNION SELECT b, a FROM e WHERE b IS NOT NULL AND a <> b),
reach(a, b) AS (SELECT a, b FROM both_ways UNION SELECT r.a, w.b FROM reach r JOIN both_ways w ON w.a = r.b),
urls AS (SELECT DISTINCT url FROM (SELECT url FROM pages UNION ALL SELECT a FROM both_ways)),
rest AS (SELECT url, CASE WHEN contains(url, '://') THEN substr(url, instr(url, '://') + 3) ELSE '' END AS r FROM urls),
hp AS (SELECT url, translate(regexp_extract(r, '^[^/?#]*', 0), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(r, '^[^/?#]*([^?#]*)', 1) AS path FROM rest),
own AS (SELECT hp.url, hp.host, hp.path, arg_max(rules.rule, length(rules.rule)) AS rule, arg_max(rules.verdict, length(rules.rule)) AS verdict FROM hp LEFT JOIN rules ON (hp.host = rules.host OR ends_with(hp.host, '.' || rules.host)) AND starts_with(hp.path, rules.path) GROUP BY ALL),
alias AS (SELECT r.a AS url, bool_or(o.verdict = 'block') AND NOT coalesce(bool_or(o.verdict = 'allow'), false) AS bad FROM reach r JOIN own o ON o.url = r.b GROUP BY 1)
SELECT p.page_id, coalesce(o.host, '') AS host, coalesce(o.path, '') AS path, o.rule, coalesce(o.verdict, CASE WHEN alias.bad THEN 'block' ELSE 'allow' END) AS verdict
FROM pages p LEFT JOIN own o ON o.url = p.url LEFT JOIN alias ON alias.url = p.url"""


@register
def op2_marginal_unigrams(spark, sf_dir):
    return language.identify(table(spark, sf_dir, "documents"))


@register
def op4_importance_resampling(spark, sf_dir):
    drawn = quality.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return drawn.select("doc_id", "log_importance", "gumbel_key")


@register
def op6_grouped_prefix_join(spark, sf_dir):
    return neardup.near_duplicates(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")
