"""Which archived page answers for an address: itself, its host by another name, or the first page there is."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cairn.functions import urls as U

#: How an address was answered, the best first. Fixed values.
EXACT, ALIAS, FALLBACK, AUTO, UNVERIFIED = "exact", "host-alias", "fallback", "auto", "unverified"


def _key(url: Column, name: Column) -> Column:
    """Scheme, host name, port unless it is the scheme's own, path and query."""
    port = U.port(url)
    usual = ((U.scheme(url) == "http") & (port == 80)) | ((U.scheme(url) == "https") & (port == 443))
    return F.struct(U.scheme(url).alias("scheme"), F.when(port.isNull() | (port == 0) | usual, name).otherwise(F.concat(name, F.lit(":"), port.cast("string"))).alias("host"), U.path(url).alias("path"), U.query(url).alias("query"))


def is_page(record_type: Column, status: Column, mime: Column, length: Column) -> Column:
    """Whether a record may stand for a site: an HTML page that was found and isn't empty."""
    return F.coalesce((status == 200) & F.startswith(F.lower(mime), F.lit("text/html")) & ~((record_type == "response") & (length == 0)), F.lit(False))


def targets(wanted: DataFrame, captured: DataFrame, job: str, order: str) -> DataFrame:
    """wanted (job, url, ...) with target and reason.

    captured: (job, order, url, page), page as is_page() says. An address asks for
    itself and for its host with or without www. at once, and the best answer
    counts; of records with one key the first. Without any the job's first page
    answers, and without that the address itself, unverified. A null address asks
    for the first page. A fragment stays with the address that was found.
    """
    url = F.col("url")
    own = captured.groupBy(F.col(job), _key(url, U.host(url)).alias("key")).agg(F.min_by("url", order).alias("found"))
    first = captured.where("page").groupBy(job).agg(F.min_by("url", order).alias("first"))
    numbered = wanted.withColumn("_row", F.monotonically_increasing_id())
    tries = [F.struct(F.lit(EXACT).alias("how"), _key(url, U.host(url)).alias("key")), F.struct(F.lit(ALIAS).alias("how"), _key(url, U.toggled_www(U.host(url))).alias("key"))]
    asked = numbered.where(url.isNotNull() & (U.host(url) != "")).select("_row", job, F.regexp_extract(url, "(#.*)$", 1).alias("fragment"), F.posexplode(F.array(*tries)).alias("rank", "t"))
    hits = asked.select("_row", job, "fragment", "rank", "t.how", "t.key").join(own, [job, "key"])
    best = hits.groupBy("_row").agg(F.min_by(F.struct(F.concat("found", "fragment").alias("target"), F.col("how").alias("reason")), "rank").alias("b"))
    out = numbered.join(best, "_row", "left").join(first, job, "left")
    target = F.coalesce("b.target", "first", "url")
    reason = F.coalesce("b.reason", F.when(F.col("first").isNotNull(), F.when(url.isNull(), AUTO).otherwise(FALLBACK)), F.lit(UNVERIFIED))
    return out.select(*wanted.columns, target.alias("target"), reason.alias("reason"))


def archived_pages(wanted: DataFrame, pages: DataFrame, site: str, order: str) -> DataFrame:
    """wanted (site, url, ...) with page: the site's page of just that address, else the first with its host (www. aside), path and query; null without any."""
    url = F.col("url")
    exact = pages.groupBy(site, "url").agg(F.lit(True).alias("_same"))
    alike = pages.groupBy(site, U.replay_key(url).alias("_key")).agg(F.min_by("url", order).alias("_page"))
    out = wanted.join(exact, [site, "url"], "left").withColumn("_key", U.replay_key(url)).join(alike, [site, "_key"], "left")
    return out.select(*wanted.columns, F.when(F.col("_same"), url).otherwise(F.col("_page")).alias("page"))
