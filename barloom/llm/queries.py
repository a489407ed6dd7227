"""The queries of this subpackage, by name."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barloom.llm import exact_dedup, filter_audit, mixing, mpeg_audio, ngram_join, packing, pitman_yor, quality, quote_links, resampling, secret_scan, suffix_dedup, url_rules
from barloom.llm.common import table


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_duplicates(table(spark, sf_dir, "documents")).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = suffix_dedup.remove_repeats(table(spark, sf_dir, "documents"))
    return got.select("doc_id", "n_bytes", (F.col("n_bytes") - F.octet_length("kept")).cast("long").alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def op3_mpeg_audio(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mpeg_audio.store_texts(table(spark, sf_dir, "documents"))


def op4_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.jaccard_classes(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id", "n_links", "group_size")


def op5_quote_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quote_links.link_quotes(table(spark, sf_dir, "conversations"), unplaced=True)


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_sources(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op7_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_rules.judge_urls(table(spark, sf_dir, "pages"))


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op10_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.scan_secrets(table(spark, sf_dir, "documents"))


def op11_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resampling.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op13_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pitman_yor.score_texts(table(spark, sf_dir, "documents"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {f.__name__: f for f in (op1_exact_dedup, op2_suffix_dedup, op3_mpeg_audio, op4_ngram_join, op5_quote_links, op6_mixing, op7_url_rules, op8_packing, op9_quality, op10_secret_scan, op11_resampling, op12_filter_audit, op13_language_model, pipeline)}

_WORDS = r"coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)"

OP1 = r"""
WITH n AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents)
SELECT doc_id, min(doc_id) OVER (PARTITION BY t) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size,
       doc_id = min(doc_id) OVER (PARTITION BY t) AS kept, sha256(t) AS text_sha256
FROM n
"""

OP6 = rf"""
WITH d AS (SELECT doc_id, source, CAST({_WORDS} AS BIGINT) AS size, md5(concat('7:', coalesce(CAST(doc_id AS VARCHAR), md5(coalesce(text, ''))))) AS k FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
w AS (SELECT *, CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS weight, 3.0::DOUBLE * source_size AS cap FROM s),
r AS (SELECT *, row_number() OVER (ORDER BY cap / weight, source NULLS LAST) AS place FROM w),
l AS (SELECT *, (sum(source_size) OVER () - coalesce(sum(cap) OVER (ORDER BY place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0))
         / sum(weight) OVER (ORDER BY place ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM r),
f AS (SELECT min_by(level, place) FILTER (WHERE cap / weight >= level) AS final FROM l),
t AS (SELECT source, source_size, CASE WHEN final IS NULL THEN cap ELSE least(cap, weight * final) END AS target FROM l, f),
b AS (SELECT *, CAST(round(target) AS BIGINT) AS budget FROM t),
p AS (SELECT d.doc_id, d.size, b.source_size, b.target, b.budget,
         coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY d.k, d.doc_id, d.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start
      FROM d JOIN b ON d.source IS NOT DISTINCT FROM b.source)
SELECT doc_id, size, source_size, target,
       CAST(CASE WHEN source_size > 0 THEN (budget // source_size) * size + greatest(0, least(size, budget % source_size - start)) ELSE 0 END AS BIGINT) AS taken
FROM p
"""

OP7 = r"""
WITH u AS (SELECT page_id,
         coalesce(translate(regexp_extract(url, '^(?s:.*?)://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
         coalesce(regexp_extract(url, '^(?s:.*?)://[^/?#]*([^?#]*)', 1), '') AS path FROM pages),
rules(h, p, verdict) AS (VALUES ('com', '/', 'allow'), ('example.com', '/en/', 'block'), ('www.example.com', '/en/', 'allow'), ('net', '/es/', 'block'), ('net', '/fr/', 'block')),
best AS (SELECT host, path, max_by(h || p, length(h || p)) AS rule, max_by(verdict, length(h || p)) AS verdict
         FROM (SELECT DISTINCT host, path FROM u) d JOIN rules ON (host = h OR host LIKE '%.' || h) AND starts_with(path, p) GROUP BY host, path)
SELECT page_id, u.host, u.path, rule, coalesce(best.verdict, CASE
         WHEN regexp_matches(u.host, '(^|\.)ad(s|server)?[0-9]*\.') THEN 'block'
         WHEN regexp_matches(u.host, '(^|[.-])(online-)?casino[.-]') THEN 'block'
         WHEN regexp_matches(u.path, '^(/[^/]*)*/wp-login\.php$') OR regexp_matches(u.path, '(^|/)pixel\.gif$') THEN 'block' ELSE 'allow' END) AS verdict
FROM u LEFT JOIN best ON u.host = best.host AND u.path = best.path
"""

_LOWER = "translate({t}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_RUNS = r"regexp_extract_all(" + _LOWER.format(t="text") + r", '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

OP11 = rf"""
WITH crc AS (SELECT list_transform(range(256), lambda x: list_reduce(list_prepend(x, [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[]), lambda c, z: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS steps),
docs AS (SELECT doc_id, row_number() OVER () AS row, coalesce({_RUNS}, []) AS words FROM documents),
uses AS (SELECT row, unnest(words) AS w FROM docs),
goals AS (SELECT unnest({_RUNS}) AS w FROM benchmark),
known AS (SELECT DISTINCT w FROM (SELECT w FROM uses UNION ALL SELECT w FROM goals)),
bytes AS (SELECT w, list_transform(range(octet_length(encode(w))), lambda k: CAST('0x' || substr(hex(encode(w)), 2 * k + 1, 2) AS BIGINT)) AS own FROM known),
hashed AS (SELECT w, xor(list_reduce(list_prepend(4294967295::BIGINT, own), lambda c, b: xor(c >> 8, steps[(xor(c, b) & 255) + 1])), 4294967295) % 10000 AS bucket FROM bytes, crc),
s AS (SELECT bucket, count(*) AS s FROM uses JOIN hashed USING (w) GROUP BY bucket), t AS (SELECT bucket, count(*) AS t FROM goals JOIN hashed USING (w) GROUP BY bucket),
whole AS (SELECT (SELECT coalesce(sum(s), 0)::DOUBLE FROM s) AS s_all, (SELECT coalesce(sum(t), 0)::DOUBLE FROM t) AS t_all),
gains AS (SELECT bucket, floor(1000 * ln((coalesce(t, 0) + 1)::DOUBLE * (s_all + 10000) / ((s + 1)::DOUBLE * (t_all + 10000))))::BIGINT AS gain FROM s LEFT JOIN t USING (bucket), whole),
sums AS (SELECT row, sum(gain)::BIGINT AS total FROM uses JOIN hashed USING (w) JOIN gains USING (bucket) GROUP BY row),
weighed AS (SELECT doc_id, row, len(words) AS n_features, CASE WHEN len(words) = 0 THEN 0 ELSE (total - ((total % len(words)) + len(words)) % len(words)) // len(words) END AS weight FROM docs LEFT JOIN sums USING (row)),
noisy AS (SELECT *, weight + floor(-1000 * ln(-ln((CAST('0x' || substr(sha256('2024:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 8) AS BIGINT) + 0.5::DOUBLE) / 4294967296.0::DOUBLE)))::BIGINT AS score FROM weighed),
placed AS (SELECT *, row_number() OVER (PARTITION BY n_features >= 20 ORDER BY score DESC, doc_id NULLS LAST, row) AS place, count(*) OVER (PARTITION BY n_features >= 20) AS n FROM noisy)
SELECT doc_id, n_features, weight, score, CASE WHEN n_features >= 20 AND place <= 10 * n // 100 THEN place END AS rank FROM placed
"""

_BITS = "(VALUES ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16))"

OP12 = rf"""
WITH d AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
l AS (SELECT doc_id, max((quality = 1)::INT) AS good, max((toxic = 1)::INT) AS toxic FROM labels WHERE doc_id IS NOT NULL GROUP BY doc_id),
m AS (SELECT part, (len(w) < 100)::INT + 2 * (100 * len(list_distinct(w)) < 80 * len(w))::INT + 4 * (100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 10 * length(t))::INT
             + 8 * regexp_matches(t, '[#$%&*|]')::INT + 16 * coalesce(doc_id > min(doc_id) OVER (PARTITION BY t), false)::INT AS mask, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic FROM d LEFT JOIN l USING (doc_id)),
c AS (SELECT part, mask, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM m GROUP BY part, mask),
b(f, bit) AS {_BITS},
orders AS (SELECT x.f || y.f || z.f || u.f || v.f AS o FROM b x, b y, b z, b u, b v WHERE len(list_distinct([x.f, y.f, z.f, u.f, v.f])) = 5),
steps AS (SELECT o, step, (SELECT bit FROM b WHERE f = substr(o, step, 1)) AS own, (SELECT coalesce(sum(bit), 0)::INT FROM b WHERE contains(substr(o, 1, step - 1), f)) AS before FROM orders, (SELECT unnest(range(1, 6))::INT AS step) s),
r AS (SELECT part, o AS filter_order, step, own, coalesce(sum(n) FILTER (WHERE mask & (own | before) = 0), 0) AS kept, coalesce(sum(n) FILTER (WHERE mask & own > 0 AND mask & before = 0), 0) AS removed,
        coalesce(sum(n) FILTER (WHERE mask & own > 0 AND mask & before > 0), 0) AS redundant, coalesce(sum(n) FILTER (WHERE mask = own), 0) AS unique_fails,
        coalesce(sum(good) FILTER (WHERE mask & own > 0 AND mask & before = 0), 0) AS good_lost, coalesce(sum(toxic) FILTER (WHERE mask & own > 0 AND mask & before = 0), 0) AS toxic_lost
      FROM c, steps GROUP BY ALL)
SELECT part, filter_order, step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed, CAST(redundant AS BIGINT) AS redundant, CAST(unique_fails AS BIGINT) AS unique_fails,
       CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost, CAST(sum(removed) OVER (PARTITION BY part, own) AS BIGINT) AS shapley FROM r
"""

ORACLE_SQL = {"op1_exact_dedup": OP1, "op6_mixing": OP6, "op7_url_rules": OP7, "op11_resampling": OP11, "op12_filter_audit": OP12}
