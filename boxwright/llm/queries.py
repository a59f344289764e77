"""The registered queries of this subpackage: ``opN_<name>`` for each operator.

Every query applies its operator, with production parameters, to its whole table.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from boxwright.llm import alignment, filter_audit, html_extract, license_scan, near_dedup, packing, pieces, quality_classifier, quality_rules, token_counts, topk, toxicity, url_filter
from boxwright.session import ship_package


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    trusted = _table(spark, sf_dir, "labels").filter("quality = 1")
    return quality_rules.judge(_table(spark, sf_dir, "documents"), trusted)


def op2_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship_package(spark)
    return near_dedup.near_duplicates(_table(spark, sf_dir, "documents"), size=3, num=85, den=100)


# fixed values: the rules of the url query, and hosts blocked where no rule fits
URL_ALLOW = ("com/", "www.example.com/en/")
URL_BLOCK = ("example.com/en/", "net/es/", "net/fr/")
URL_HOSTS = tuple(f"{name}.example.{top}" for name in ("casino-win", "cheap-pills", "ads-track", "spam-farm", "adult-x") for top in ("com", "net", "org"))


def op3_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge_urls(_table(spark, sf_dir, "pages"), URL_ALLOW, URL_BLOCK, URL_HOSTS)


_HOSTS_SQL = " OR ".join(f"host = '{h}' OR suffix(host, '.{h}')" for h in URL_HOSTS)
OP3_SQL = f"""
WITH u AS (
  SELECT page_id, coalesce(url, '') AS url, position('://' IN coalesce(url, '')) AS pos FROM pages),
r AS (SELECT page_id, CASE WHEN pos > 0 THEN substr(url, pos + 3) ELSE '' END AS rest FROM u),
p AS (
  SELECT page_id,
    translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path
  FROM r),
rules(rule, h, pre, v) AS (VALUES
  ('com/', 'com', '/', 'allow'), ('example.com/en/', 'example.com', '/en/', 'block'),
  ('www.example.com/en/', 'www.example.com', '/en/', 'allow'),
  ('net/es/', 'net', '/es/', 'block'), ('net/fr/', 'net', '/fr/', 'block')),
hit AS (
  SELECT page_id, host, path, arg_max(rule, length(rule)) AS rule, arg_max(v, length(rule)) AS v
  FROM p LEFT JOIN rules ON (host = h OR suffix(host, '.' || h)) AND starts_with(path, pre)
  GROUP BY page_id, host, path)
SELECT page_id, host, path, rule,
  CASE WHEN rule IS NOT NULL THEN v WHEN {_HOSTS_SQL} THEN 'block' ELSE 'allow' END AS verdict
FROM hit
"""


def op4_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship_package(spark)
    return topk.top_k(_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


OP4_SQL = """
WITH v AS (
  SELECT row_number() OVER () AS n, vec_id, [CAST(floor(1024 * CAST(x AS DOUBLE)) AS DOUBLE) FOR x IN embedding] AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
    AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0),
s AS (
  SELECT q.n, q.vec_id AS query_id, p.vec_id, CAST(list_dot_product(q.v, p.v) AS BIGINT) AS score
  FROM v q JOIN v p ON q.vec_id % 100 = 0 AND q.n <> p.n AND len(q.v) = len(p.v)),
r AS (SELECT *, row_number() OVER (PARTITION BY n ORDER BY score DESC, vec_id) AS k FROM s)
SELECT query_id, CAST(k AS INTEGER) AS rank, vec_id, score FROM r WHERE k <= 10
"""


def op5_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship_package(spark)
    return pieces.round_trip(_table(spark, sf_dir, "documents"))


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship_package(spark)
    return packing.pack(_table(spark, sf_dir, "documents"))


def op7_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan(_table(spark, sf_dir, "documents"))


def op8_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship_package(spark)
    return quality_classifier.classify(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op9_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship_package(spark)
    pages = _table(spark, sf_dir, "pages")
    return html_extract.extract(pages, html_extract.train(pages))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship_package(spark)
    docs = _table(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.train(docs, _table(spark, sf_dir, "labels")))


def op11_tokenizer_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship_package(spark)
    return alignment.align_and_score(_table(spark, sf_dir, "documents"))


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.audit(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


OP12_SQL = r"""
WITH d AS (
  SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t,
    regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
firsts AS (SELECT t, min(doc_id) AS least FROM d GROUP BY t),
f AS (
  SELECT d.doc_id, part,
    (CASE WHEN len(w) < 50 THEN 1 ELSE 0 END) + (CASE WHEN 100 * len(list_distinct(w)) < 65 * len(w) THEN 2 ELSE 0 END)
    + (CASE WHEN 100 * length(regexp_replace(d.t, '[^A-Z]+', '', 'g')) > 5 * length(d.t) THEN 4 ELSE 0 END)
    + (CASE WHEN regexp_matches(d.t, '[#$%&*|]') THEN 8 ELSE 0 END) + (CASE WHEN least < d.doc_id THEN 16 ELSE 0 END) AS bits
  FROM d JOIN firsts ON d.t = firsts.t),
l AS (SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic FROM labels GROUP BY doc_id),
c AS (
  SELECT part, bits, count(*) AS n, coalesce(sum(good), 0) AS good, coalesce(sum(toxic), 0) AS toxic
  FROM f LEFT JOIN l ON f.doc_id = l.doc_id GROUP BY part, bits),
letters AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x),
orders AS (
  SELECT a.x || b.x || c.x || d.x || e.x AS o FROM letters a, letters b, letters c, letters d, letters e
  WHERE len(list_distinct([a.x, b.x, c.x, d.x, e.x])) = 5),
s AS (
  SELECT o, step, 1 << (ascii(substr(o, step, 1)) - 65) AS own,
    list_sum([1 << (ascii(substr(o, k, 1)) - 65) FOR k IN range(1, step)] || [0]) AS before
  FROM orders, (SELECT unnest(range(1, 6)) AS step))
SELECT part, o AS filter_order, CAST(step AS INTEGER) AS step,
  CAST(sum(CASE WHEN bits & (before | own) = 0 THEN n ELSE 0 END) AS BIGINT) AS kept,
  CAST(sum(CASE WHEN bits & own <> 0 AND bits & before = 0 THEN n ELSE 0 END) AS BIGINT) AS removed,
  CAST(sum(CASE WHEN bits & own <> 0 AND bits & before <> 0 THEN n ELSE 0 END) AS BIGINT) AS redundant,
  CAST(sum(CASE WHEN bits = own THEN n ELSE 0 END) AS BIGINT) AS unique_fails,
  CAST(sum(CASE WHEN bits & own <> 0 AND bits & before = 0 THEN good ELSE 0 END) AS BIGINT) AS good_lost,
  CAST(sum(CASE WHEN bits & own <> 0 AND bits & before = 0 THEN toxic ELSE 0 END) AS BIGINT) AS toxic_lost,
  CAST(sum(CASE WHEN bits & own <> 0 THEN n * 120 // bit_count(bits) ELSE 0 END) AS BIGINT) AS shapley
FROM c, (SELECT o, step, own, CAST(before AS INTEGER) AS before FROM s) GROUP BY part, o, step
"""


def op13_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship_package(spark)
    return token_counts.count_tokens(_table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_quality_rules": op1_quality_rules,
        "op2_minhash_dedup": op2_minhash_dedup,
        "op3_url_filter": op3_url_filter,
        "op4_top_k": op4_top_k,
        "op5_pieces": op5_pieces,
        "op6_packing": op6_packing,
        "op7_license_scan": op7_license_scan,
        "op8_quality_classifier": op8_quality_classifier,
        "op9_html_extraction": op9_html_extraction,
        "op10_toxicity": op10_toxicity,
        "op11_tokenizer_alignment": op11_tokenizer_alignment,
        "op12_filter_audit": op12_filter_audit,
        "op13_token_counts": op13_token_counts,
    }


def oracle_sql() -> dict[str, str]:
    return {"op3_url_filter": OP3_SQL, "op4_top_k": OP4_SQL, "op12_filter_audit": OP12_SQL}
