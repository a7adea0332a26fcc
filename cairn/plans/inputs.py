"""How the archive's tables are seen in the given ones, in Spark and in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairn.sources.shared import shared_folder, written  # noqa: F401


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Captures: a document is a payload that job `source` found; the site is its language, the page its first word.
CAPTURES = r"""
captures0 AS (SELECT doc_id AS id, CAST(regexp_extract(source, '([0-9]+)$', 1) AS BIGINT) AS crawl_id,
  'http://' || lang || '.example.com/' || lower(regexp_extract(text, '([A-Za-z]+)', 1)) AS url_key,
  'sha1:' || sha1(text) AS digest, doc_id * 60 AS seen_at, n_chars AS length,
  CASE WHEN n_chars < 100 THEN 404 ELSE 200 END AS status FROM documents),
captures AS (SELECT *, CASE WHEN id = min(id) OVER d THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN id > min(id) OVER d THEN arg_min(crawl_id, id) OVER d END AS refers_to,
  CASE WHEN id > min(id) OVER d THEN min(id) OVER d END AS refers_to_id FROM captures0 WINDOW d AS (PARTITION BY digest))"""


def captures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, crawl_id, url_key, digest, seen_at, length, status) in order of arrival."""
    d = table(spark, sf_dir, "documents")
    word = F.lower(F.regexp_extract("text", "([A-Za-z]+)", 1))
    return d.select(
        F.col("doc_id").alias("id"),
        F.regexp_extract("source", "([0-9]+)$", 1).cast("long").alias("crawl_id"),
        F.concat(F.lit("http://"), "lang", F.lit(".example.com/"), word).alias("url_key"),
        F.concat(F.lit("sha1:"), F.sha1("text")).alias("digest"),
        (F.col("doc_id") * 60).alias("seen_at"),
        F.col("n_chars").alias("length"),
        F.when(F.col("n_chars") < 100, 404).otherwise(200).alias("status"),
    )
