"""The registered queries of this subpackage, each over its whole table, and their SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ann, bpe, language_id, line_dedup, near_dedup, packing, quality, secret_scan, sharding, url_filter


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def op2_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(table(spark, sf_dir, "documents")).select("doc_id", "class_id", (F.col("doc_id") == F.col("class_id")).alias("kept"))


def op3_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_decode(table(spark, sf_dir, "documents"), digests=True)


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge(table(spark, sf_dir, "documents"))


def op5_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.search(table(spark, sf_dir, "embeddings"))


def op6_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.filter_urls(table(spark, sf_dir, "pages"))


def op7_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = secret_scan.scan(docs, secret_scan.train(docs))
    listed = secret_scan.listing("spans")
    return found.select("doc_id", "n_assign", "n_access", "n_hex", F.sha2(secret_scan.listing("spans", True), 256).alias("base_sha256"), listed.alias("spans"))


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = language_id.train(docs.where(~language_id.held_out()))
    return language_id.identify(docs, model).select("doc_id", language_id.held_out().alias("held_out"), "lang_pred", "score")


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cleaned = line_dedup.deduplicated(table(spark, sf_dir, "documents"), counts=True)
    return cleaned.select("doc_id", "n_lines", F.size("dropped").alias("n_dropped"), F.array_join("dropped", ",").alias("dropped"), F.sha2("text", 256).alias("text_sha256"))


def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.balanced_shards(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    own = (op1_packing, op2_near_dedup, op3_bpe, op4_quality, op5_ann, op6_url_filter, op7_secret_scan, op8_language_id, op9_line_dedup, op10_sharding)
    return {f.__name__: f for f in own}


_OP6_SQL = """
WITH p AS (SELECT page_id, url, CASE WHEN contains(url, '://') THEN substr(url, instr(url, '://') + 3) END AS rest FROM pages),
 h AS (SELECT row_number() OVER () AS nr, page_id, lower(coalesce(url, '')) AS low, coalesce(translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
   coalesce(regexp_extract(rest, '^[^/?#]*([^?#]*)', 1), '') AS path FROM p),
 r(rhost, rpath, action) AS (VALUES ('com', '/en/', 'block'), ('example.com', '/en/7', 'allow'), ('net', '/de/', 'block'), ('example.net', '/de/8', 'block'), ('org', '/es/', 'block')),
 f AS (SELECT nr, rhost || rpath AS rule, action, row_number() OVER (PARTITION BY nr ORDER BY length(rhost || rpath) DESC) AS rk FROM h JOIN r ON (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath)),
 q AS (SELECT h.*, f.rule, f.action, CASE WHEN regexp_matches(low, '/wp-login\\.php(?:[?#]|$)') THEN 'login' WHEN regexp_matches(low, '[?&]add-to-cart=\\d+') THEN 'cart' WHEN regexp_matches(low, '/calendar/\\d{4}/\\d{2}(?:/|$)') THEN 'calendar'
   WHEN regexp_matches(low, '[?&]utm_source=') THEN 'feed-copy' WHEN regexp_matches(low, '[?&]page=\\d{2,}(?:[&#]|$)') THEN 'listing-page' END AS hit FROM h LEFT JOIN f ON h.nr = f.nr AND f.rk = 1)
SELECT page_id, host, path, rule, coalesce(action, CASE WHEN hit IS NOT NULL THEN 'block' ELSE 'allow' END) AS verdict, CASE WHEN rule IS NULL THEN hit END AS pattern FROM q"""


def oracle_sql() -> dict[str, str]:
    """Only URL rules can be said in SQL; the others are tested against brute-force versions."""
    return {"op6_url_filter": _OP6_SQL}
