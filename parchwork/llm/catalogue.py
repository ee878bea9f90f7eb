"""The operators of this package as queries over the driver's tables."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parchwork.llm import hyperplane, langid, licences, minhash, mixing, multiindex, packing, secrets, tokencount, urls


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return packing.digests(packing.pack(docs, public_tokenizers.path("word_bpe_49k.json")))


def op2_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(_table(spark, sf_dir, "documents"))


def op3_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.find_secrets(_table(spark, sf_dir, "documents"), secrets.learn(secrets.labelled_credentials()))


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(_table(spark, sf_dir, "documents"))


def op5_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """pages has no fetch times and there is no list, so both are derived: a day for each page, entries for each host."""
    pages = _table(spark, sf_dir, "pages").select(
        "page_id", "url", F.expr("timestamp '2024-01-01 00:00:00' + make_dt_interval(cast(page_id % 730 as int))").alias("fetched")
    )
    hosts = pages.groupBy(urls.host(F.col("url")).alias("key")).agg(F.min("page_id").alias("first")).where("key != '' and first % 3 != 0")
    day = "timestamp '2024-01-01 00:00:00' + make_dt_interval(cast((first * 7) % 500 + {} as int))"
    listed = lambda days, on: F.struct(F.expr(day.format(days)).alias("at"), F.lit(on).alias("listed"))
    dated = F.explode(F.filter(F.array(listed(0, True), listed(90, False), listed(200, True)), lambda x: x.listed | (F.col("first") % 2 == 0)))
    entries = hosts.select("key", dated.alias("e")).select("key", F.lit("hosts").alias("list"), "e.at", "e.listed")
    fixed = spark.sql(
        "select key, 'domains' as list, cast(at as timestamp) as at, listed from values "
        "('example.org', '2024-03-01', true), ('example.org', '2024-09-15', false), ('example.org', '2025-05-01', true), "
        "('m.example.net', '2024-02-01', true) as t(key, at, listed)"
    )
    return urls.filter_urls(pages, entries.unionByName(fixed), id_col="page_id", url_col="url", time_col="fetched")


OP5_SQL = r"""
WITH captures AS (
  SELECT page_id, timestamp '2024-01-01 00:00:00' + to_days(CAST(page_id % 730 AS INTEGER)) AS fetched,
    lower(regexp_replace(regexp_replace(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.\-]*://([^/?#\\]*)', 1), '^.*@', ''), '\.?(?::[0-9]*)?$', '')) AS host,
    regexp_replace(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.\-]*://[^/?#\\]*([^?#]*)', 1), '/+$', '') AS path
  FROM pages
), hosts AS (
  SELECT host AS key, min(page_id) AS first FROM captures GROUP BY host HAVING host <> '' AND min(page_id) % 3 <> 0
), entries AS (
  SELECT key, 'hosts' AS list, timestamp '2024-01-01 00:00:00' + to_days(CAST((first * 7) % 500 + days AS INTEGER)) AS day, listed
  FROM hosts, (VALUES (0, true), (90, false), (200, true)) d(days, listed) WHERE listed OR first % 2 = 0
  UNION ALL
  SELECT key, 'domains', CAST(day AS timestamp), listed FROM (VALUES ('example.org', '2024-03-01', true),
    ('example.org', '2024-09-15', false), ('example.org', '2025-05-01', true), ('m.example.net', '2024-02-01', true)) f(key, day, listed)
), last AS (  -- the state of each key at each entry, and until when
  SELECT key, list, day, listed, lead(day, 1, timestamp '9999-12-31 00:00:00') OVER (PARTITION BY list, key ORDER BY day) AS until,
    lag(listed) OVER (PARTITION BY list, key ORDER BY day) AS was FROM entries
), runs AS (
  SELECT key, list, day, until, listed, sum(CASE WHEN was IS NULL OR was <> listed THEN 1 ELSE 0 END) OVER (PARTITION BY list, key ORDER BY day) AS run FROM last
), spans AS (
  SELECT key, list, min(day) AS since, max(until) AS until FROM runs WHERE listed GROUP BY key, list, run
), keyed AS (
  SELECT DISTINCT page_id, fetched, key FROM (
    SELECT page_id, fetched, unnest(list_transform(range(1, len(string_split(host, '.')) + 1), lambda k: array_to_string(string_split(host, '.')[k:], '.'))) AS key FROM captures
    UNION ALL SELECT page_id, fetched, host || path FROM captures
  ) WHERE key <> ''
), held AS (
  SELECT page_id, count(DISTINCT list) AS n_lists, min(since) AS listed_since FROM keyed JOIN spans USING (key)
  WHERE fetched >= since AND fetched < until GROUP BY page_id
)
SELECT page_id, host, fetched, coalesce(n_lists, 0) AS n_lists, listed_since, coalesce(n_lists, 0) > 0 AS blocked
FROM captures LEFT JOIN held USING (page_id)
"""


def op6_nearest_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return multiindex.search(_table(spark, sf_dir, "embeddings"))


def op7_licence_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licences.scan(_table(spark, sf_dir, "documents"), licences.train())


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokencount.token_counts(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op9_near_duplicate_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hyperplane.near_duplicate_vectors(_table(spark, sf_dir, "embeddings"))


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select(
        "doc_id", "text", "lang", (F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(3)) == 1).alias("held_out")
    )
    model = langid.train(docs.where(~F.col("held_out")))
    named = langid.identify(docs, model, keep=["held_out"])
    return named.withColumn("spans", F.array_join(F.transform("spans", lambda x: F.concat_ws(":", x.start, x.end, x.lang)), ","))


QUERIES = {f.__name__: f for f in (op1_packing, op2_near_duplicates, op3_secret_scan, op4_mixing, op5_url_filters, op6_nearest_vectors, op7_licence_scan, op8_token_counts, op9_near_duplicate_vectors, op10_language_id)}


def oracles() -> dict[str, str]:
    return {"op5_url_filters": OP5_SQL, "op7_licence_scan": licences.sql(licences.train())}
