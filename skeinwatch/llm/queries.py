"""The registered queries of the subpackage, thin over its operators, and the SQL they must match."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe_codec, decontaminate, hard_negatives, licenses, maxent_lm, quality, secret_scan, simhash, source_audit, token_counts, url_rules, warc, winnowing

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query()
def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    counted = token_counts.count_tokens(docs, public_tokenizers.path("byte_bpe_50k.json"))
    return counted.select("doc_id", "n_bytes", "n_tokens", "over_limit")


@query()
def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.components(table(spark, sf_dir, "documents"))


@query()
def op3_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.scan(table(spark, sf_dir, "documents"))


@query()
def op4_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    ranks = public_tokenizers.path("byte_bpe_50k.tiktoken")
    return bpe_codec.encoded(docs, ranks, public_tokenizers.PATTERN).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")


_OP5_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
d AS (SELECT page_id, octet_length(encode(html)) AS n, sha1(html) AS digest FROM p),
g AS (SELECT digest, max(page_id) AS target FROM d WHERE n >= 1000 GROUP BY digest HAVING count(*) > 1 AND max(page_id) IS NOT NULL)
SELECT page_id, n AS payload_bytes, digest AS payload_digest,
    CASE WHEN target IS NOT NULL AND page_id IS DISTINCT FROM target THEN 'revisit' ELSE 'response' END AS record_type,
    CASE WHEN page_id IS DISTINCT FROM target THEN target END AS refers_to
FROM d LEFT JOIN g USING (digest)"""


@query(_OP5_SQL)
def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = warc.round_trip(table(spark, sf_dir, "pages"))
    return records.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


@query()
def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    return quality.assess(docs).drop("text", "lang")


@query()
def op7_maxent_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return maxent_lm.score_texts(table(spark, sf_dir, "documents"))


@query()
def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def _op9_sql() -> str:
    """Host rules and patterns tried one by one on every URL."""
    table_of = {"by_host": [], "pattern": []}
    for v, h, p in url_rules.HOST_RULES:
        table_of["by_host"].append(f"('{h}{p}', '{v}', '{h}', '{p}')")
    for r in map(url_rules.pattern_rule, url_rules.PATTERNS):
        table_of["pattern"].append(f"('{r['rule']}', '{r['verdict']}', '{r['regex']}')")
    return f"""
WITH host_rules(rule, verdict, rule_host, rule_path) AS (VALUES {", ".join(table_of["by_host"])}),
patterns(rule, verdict, regex) AS (VALUES {", ".join(table_of["pattern"])}),
split AS (
    SELECT page_id, coalesce(url, '') AS url,
        CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest
    FROM pages),
parts AS (
    SELECT row_number() OVER () AS r, page_id, url,
        translate(regexp_extract(rest, '^[^/?#]*', 0), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
        regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path
    FROM split),
by_host AS (
    SELECT r, arg_max(h.rule, length(h.rule)) AS rule, arg_max(h.verdict, length(h.rule)) AS verdict
    FROM parts JOIN host_rules h
        ON (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path)
    GROUP BY r),
by_pattern AS (
    SELECT r, arg_max(p.rule, (p.verdict = 'allow', length(p.rule), p.rule)) AS pattern,
        arg_max(p.verdict, (p.verdict = 'allow', length(p.rule), p.rule)) AS verdict
    FROM parts JOIN patterns p ON regexp_matches(url, p.regex)
    WHERE r NOT IN (SELECT r FROM by_host)
    GROUP BY r)
SELECT page_id, host, path, h.rule AS rule, coalesce(h.verdict, p.verdict, 'allow') AS verdict, p.pattern AS pattern
FROM parts LEFT JOIN by_host h USING (r) LEFT JOIN by_pattern p USING (r)"""


@query(_op9_sql())
def op9_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_rules.judge(table(spark, sf_dir, "pages"), url_rules.rules_table(spark))


@query()
def op10_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.recognise(table(spark, sf_dir, "documents"), licenses.rule_steps(spark))


_OP11_SQL = """
WITH v AS (
    SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
        list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS q
    FROM embeddings
    WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
        AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
    SELECT DISTINCT a.vec_id AS anchor_id, b.vec_id AS id, a.label = b.label AS same, CAST(list_dot_product(a.q, b.q) AS BIGINT) AS score
    FROM v a JOIN v b ON a.vec_id <> b.vec_id OR a.label <> b.label
    WHERE a.vec_id % 100 = 0),
positives AS (
    SELECT anchor_id, id AS positive_id, score AS positive_score
    FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5)
SELECT anchor_id, positive_id,
    CAST(row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY s.score DESC, s.id) AS INTEGER) AS rank,
    s.id AS negative_id, positive_score, s.score AS negative_score
FROM positives JOIN s USING (anchor_id)
WHERE NOT same AND 30 * positive_score <= 100 * s.score AND 100 * s.score <= 90 * positive_score
QUALIFY row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY s.score DESC, s.id) <= 10"""


@query(_OP11_SQL)
def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = hard_negatives.usable(table(spark, sf_dir, "embeddings"))
    noisy = rows.withColumn("label", F.when(F.col("id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")))
    return hard_negatives.mine(noisy, F.col("id") % 100 == 0)


@query()
def op12_winnowing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return winnowing.compare_with_edits(table(spark, sf_dir, "documents"))


_OP13_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, coalesce(text, '') AS text, coalesce(lang, '') AS lang, coalesce(source, '') AS source FROM documents),
g AS (SELECT DISTINCT lang, source FROM d),
w AS (
    SELECT r, lang, source,
        unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term
    FROM d),
kept AS (SELECT lang, term, count(*) AS k FROM w GROUP BY lang, term HAVING count(DISTINCT r) >= 30),
c AS (
    SELECT g.lang, g.source, kept.term, count(w.term) AS n
    FROM g JOIN kept USING (lang) LEFT JOIN w ON w.lang = g.lang AND w.source = g.source AND w.term = kept.term
    GROUP BY g.lang, g.source, kept.term),
t AS (
    SELECT *, sum(n) OVER (PARTITION BY lang, source) AS total, count(*) OVER (PARTITION BY lang, source) AS v FROM c),
l AS (
    SELECT lang, term, 1 + (1000000000 * CAST(k + 5 AS HUGEINT)) // CAST(sum(k) OVER (PARTITION BY lang) + 5 * count(*) OVER (PARTITION BY lang) AS HUGEINT) AS q FROM kept),
p AS (SELECT lang, source, term, n, 1 + (1000000000 * CAST(n + 5 AS HUGEINT)) // CAST(total + 5 * v AS HUGEINT) AS p FROM t),
pairs AS (
    SELECT a.lang, a.source, b.source AS item, coalesce(sum(abs(x.p - y.p)), 0) AS value
    FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
    LEFT JOIN p x ON x.lang = a.lang AND x.source = a.source
    LEFT JOIN p y ON y.lang = b.lang AND y.source = b.source AND y.term = x.term
    GROUP BY a.lang, a.source, b.source),
every AS (
    SELECT lang, source, 'pair' AS part, item, CAST(value AS BIGINT) AS value FROM pairs
    UNION ALL
    SELECT lang, source, 'term', term, CAST(p - q AS BIGINT) FROM p JOIN l USING (lang, term) WHERE n > 0 AND p > q)
SELECT *, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) AS rank
FROM every QUALIFY part = 'pair' OR rank <= 50"""


@query(_OP13_SQL)
def op13_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source_audit.divergence(table(spark, sf_dir, "documents"))
