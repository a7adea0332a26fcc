"""Queries that write WARC files from documents and read them back."""

from __future__ import annotations

from pyspark.sql import functions as F

from cairn.operators import search_documents as D
from cairn.plans.catalog import Catalog
from cairn.plans.inputs import shared_folder, table
from cairn.sources import warc

query = Catalog()
QUERIES, ORACLE = query.queries, query.sql


def _records(spark, sf):
    """Documents as records: copies as revisits of the first document of their text."""
    d = table(spark, sf, "documents")
    first = d.groupBy("text").agg(F.min("doc_id").alias("first"))
    d, c = d.join(first, "text"), F.col
    urn = lambda i: F.concat(F.lit("<urn:doc:"), i.cast("string"), F.lit(">"))
    again = c("doc_id") > c("first")
    header = lambda n, v: F.struct(F.lit(n).alias("name"), v.alias("value"))
    return d.select(
        F.lit(None).cast("string").alias("warc_file"), F.lit(None).cast("long").alias("record_offset"), F.when(again, "revisit").otherwise("response").alias("record_type"), urn(c("doc_id")).alias("record_id"),
        F.concat(F.lit("http://"), c("lang"), F.lit(".example.com/"), c("doc_id").cast("string")).alias("target_uri"), F.lit("2024-01-01T00:00:00Z").alias("warc_date"), F.concat(F.lit("sha1:"), F.sha1("text")).alias("payload_digest"),
        F.when(again, urn(c("first"))).alias("refers_to_id"), F.lit(None).cast("string").alias("refers_to_uri"), F.lit(None).cast("string").alias("refers_to_date"), F.when(c("n_chars") < 100, 404).otherwise(200).alias("http_status"),
        F.array(header("Content-Type", F.lit("text/plain; charset=utf-8")), header("X-Source", c("source"))).alias("http_headers"), F.lit(None).cast("string").alias("content_type"), F.lit(None).cast("long").alias("content_length"),
        c("text").cast("binary").alias("body"), F.lit(None).cast("string").alias("error"), F.lit(None).cast("boolean").alias("hash_matched"),
    )


def _written(spark, sf, most: int = 4 << 20):
    spark.dataSource.register(warc.WarcSink)
    folder = shared_folder(spark, "warc")
    _records(spark, sf).write.format("warc_out").option("max_bytes", most).mode("append").save(folder)
    return folder


_DOCS = "WITH d AS (SELECT *, doc_id > min(doc_id) OVER (PARTITION BY text) AS again, min(doc_id) OVER (PARTITION BY text) AS first FROM documents)"


@query("s01_k01_warc_round_trip", _DOCS + """ SELECT 'http://' || lang || '.example.com/' || doc_id AS target_uri, CASE WHEN again THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN again THEN '<urn:doc:' || first || '>' END AS refers_to_id,
  CASE WHEN n_chars < 100 THEN 404 ELSE 200 END AS http_status, source AS said, CASE WHEN again THEN 0 ELSE strlen(text) END AS size, CASE WHEN again THEN sha1('') ELSE sha1(text) END AS sha1 FROM d""")
def s01(spark, sf):
    said = F.filter("http_headers", lambda h: h["name"] == "X-Source")[0]["value"]
    return warc.read(spark, _written(spark, sf)).select("target_uri", "record_type", "refers_to_id", "http_status", said.alias("said"), F.length("body").cast("long").alias("size"), F.sha1("body").alias("sha1"))


@query("s02_s21_captures_of_headers", _DOCS + " SELECT '<urn:doc:' || doc_id || '>' AS record_id, CASE WHEN n_chars < 100 THEN 404 ELSE 200 END AS status, 'text/plain' AS mime, NOT again OR text = '' AS hash_matched, false AS orphaned FROM d")
def s02(spark, sf):
    return warc.captures(warc.read(spark, _written(spark, sf), bodies=False)).select("record_id", "status", "mime", "hash_matched", "orphaned")


@query("s02_response_heads", _DOCS + """ SELECT 'http://' || lang || '.example.com/' || doc_id AS target_uri, CASE WHEN n_chars < 100 THEN 404 ELSE 200 END AS http_status, strlen(text) + strlen(source) + 72 AS content_length FROM d WHERE NOT again""")
def s02_heads(spark, sf):
    """Where responses are, by heads alone, in files that are cut into ranges."""
    return warc.read(spark, _written(spark, sf, 64 << 20), light=True, types=("response",), split=1 << 20).select("target_uri", "http_status", "content_length")


@query("s03_fetched_records", _DOCS + " SELECT '<urn:doc:' || doc_id || '>' AS record_id, sha1(text) AS sha1, true AS hash_matched FROM d WHERE NOT again AND n_chars < 100")
def s03(spark, sf):
    """Responses that weren't found are looked up among heads and then read, each from its own offset."""
    folder = _written(spark, sf)
    heads = warc.response_heads(spark, folder).where("http_status = 404")
    files = warc.listed(spark, folder).select("path", F.element_at(F.split("path", "/"), -1).alias("warc_file"))
    return warc.fetched(heads.join(files, "warc_file")).select("record_id", F.sha1("body").alias("sha1"), "hash_matched")


@query("k02_extracted_records", _DOCS + " SELECT doc_id FROM d WHERE NOT again AND strlen(text) + strlen(source) + 72 <= 1000")
def k02(spark, sf):
    rows = warc.extracted(warc.read(spark, _written(spark, sf), types=("response",)), 1000)
    return rows.select(F.regexp_extract("record_id", "([0-9]+)", 1).cast("long").alias("doc_id"))


# ---- search documents of platform records and of WARC records ---------------------------


def _x_posts(spark, sf):
    link = lambda full, short: F.struct(full.alias("expanded_url"), short.alias("url"))
    d, c = table(spark, sf, "documents"), F.col
    return d.select(c("doc_id").alias("post_id"), F.when(c("doc_id") % 3 == 0, F.concat(F.lit("https://x.com/a/status/"), c("doc_id").cast("string"))).alias("permalink_url"), "text", c("source").alias("author_handle"), c("lang").alias("author_name"), F.lit("2024-02-03T04:05:06Z").alias("created_time"),
                    F.array(c("lang"), c("lang"), F.lit("")).alias("hashtags"), c("lang"), F.array(link(F.lit("http://A.example/x"), F.lit("http://t.co/a")), link(F.lit(None).cast("string"), F.lit("http://b.example/")), link(F.lit(""), F.lit(None).cast("string"))).alias("urls"), F.array(F.lit("http://a.example/i.jpg")).alias("media_urls"), F.when(c("doc_id") % 2 == 0, "reply").alias("capture_role"), c("n_chars").alias("like_count"), F.array(F.lit("p"), F.lit("q")).alias("mentions"))


_FLAT = r"trim(regexp_replace(text, '\s+', ' ', 'g'), ' ')"
_CAPTURED = "2024-03-01 00:00:00"


@query("p05_x_posts", rf"""SELECT 'x:post:' || doc_id AS id, 'X Post' AS type, 'x/' || CASE WHEN doc_id % 2 = 0 THEN 'reply' ELSE 'post' END AS category, CASE WHEN doc_id % 3 = 0 THEN 'https://x.com/a/status/' ELSE 'https://x.com/i/status/' END || doc_id AS url, nullif({_FLAT}, '') AS content,
 concat_ws('|', nullif('@' || source, '@'), nullif(lang, '')) AS author, lang AS keywords, '2024-02-03T04:05:06Z' AS publication_date, 'http://A.example/x http://b.example/' AS links, 'a.example b.example' AS hosts, 'platform=x;kind=post;' || CASE WHEN doc_id % 2 = 0 THEN 'capture_role=reply;' ELSE '' END || 'like_count=' || n_chars || ';mentions=p,q' AS meta, 'sha1:' || sha1(nullif({_FLAT}, '')) AS hash FROM documents""")
def p05(spark, sf):
    d = D.built(_x_posts(spark, sf), D.BY_NAME["x", "post"], "c", F.lit(_CAPTURED).cast("timestamp"))
    joined = lambda c, by: F.array_join(c, by)
    return d.select("id", "type", "category", "url", "content", joined("author", "|").alias("author"), joined("keywords", " ").alias("keywords"), "publication_date", joined("links", " ").alias("links"), joined("links_hosts", " ").alias("hosts"), joined("content_metadata_ss", ";").alias("meta"), "hash")


@query("p04_evidence", r"""WITH c AS (SELECT conv_id * 1000 + turn AS k, CASE WHEN conv_id % 3 = 0 THEN 'https://i.example/own/' || conv_id || '/' ELSE 'https://www.instagram.com/p/s' || conv_id || '/' END AS post, conv_id, turn FROM conversations)
SELECT 'instagram:comment:' || k AS id, post || 'c/' || k || '/' AS url, CASE WHEN k % 2 = 0 THEN post || 'c/' || k || '/' WHEN conv_id % 5 > 0 THEN post WHEN turn > 0 THEN 'https://saved.example/' || k END AS found_by,
  CASE WHEN k % 2 = 0 THEN 'comment' WHEN conv_id % 5 > 0 THEN 'post' WHEN turn > 0 THEN 'saved' END AS source_file FROM c""")
def p04_evidence(spark, sf):
    """Comments get their posts' addresses; even ones have records of their own, others those of their post or of the page they were saved from."""
    t, c = table(spark, sf, "conversations"), F.col
    text = lambda name: c(name).cast("string")
    code = F.concat(F.lit("s"), text("conv_id"))
    posts = t.select(code.alias("shortcode"), F.when(c("conv_id") % 3 == 0, F.concat(F.lit("https://i.example/own/"), text("conv_id"), F.lit("/"))).alias("permalink_url"))
    key = c("conv_id") * 1000 + c("turn")
    comments = t.select(key.alias("comment_id"), code.alias("post_shortcode"), "text", "conv_id", "turn", F.struct(F.concat(F.lit("https://saved.example/"), key.cast("string")).alias("url")).alias("provenance"))
    comments = D.with_parents(comments, posts, "post_shortcode", "shortcode", F.concat(F.lit("https://www.instagram.com/p/"), c("post_shortcode"), F.lit("/")))
    docs = D.built(comments, D.BY_NAME["instagram", "comment"], "c", F.lit(_CAPTURED).cast("timestamp"))
    record = lambda rows, url, name: rows.select(D.U.normalised(url).alias("url_norm"), F.lit(200).alias("status"), F.lit(name).alias("source_file"), F.lit(0).alias("source_file_offset"), F.lit("d").alias("digest"))
    own = F.concat("parent_permalink", F.lit("c/"), text("comment_id"), F.lit("/"))
    records = record(comments.where(c("comment_id") % 2 == 0), own, "comment").unionByName(record(comments.where(c("conv_id") % 5 > 0).select("parent_permalink").distinct(), c("parent_permalink"), "post")).unionByName(record(comments.where("turn > 0"), c("provenance.url"), "saved"))
    return D.located_by_evidence(docs, records).select("id", "url", "found_by", "source_file")


@query("p04_p06_capture_documents", """SELECT 'instagram:comment:' || (conv_id * 1000 + turn) AS id, 'Instagram Comment' AS type, 'https://www.instagram.com/p/s' || conv_id || '/c/' || (conv_id * 1000 + turn) || '/' AS url, role AS author, CAST(20240301000000 AS BIGINT) AS wayback_date FROM conversations
UNION ALL SELECT 'instagram:profile:' || c_custkey, 'Instagram Profile', 'https://www.instagram.com/' || c_name || '/', c_name, CAST(20240301000000 AS BIGINT) FROM customer
UNION ALL SELECT 'youtube:channel:' || s_suppkey, 'YouTube Channel', 'https://www.youtube.com/' || s_name, s_name, CAST(20240301000000 AS BIGINT) FROM supplier
UNION ALL SELECT 'youtube:comment:' || event_id, 'YouTube Comment', CASE WHEN event_id % 2 = 0 THEN 'http://y/post?lc=' ELSE 'http://y/watch?v=1&lc=' END || event_id, event_type, CAST(20240301000000 AS BIGINT) FROM events
UNION ALL SELECT 'facebook:comment:' || o_orderkey, 'Facebook Comment', CASE WHEN o_orderkey % 2 = 0 THEN 'http://f/p' || o_custkey || '?comment_id=' || o_orderkey END, o_orderstatus, CAST(20240301000000 AS BIGINT) FROM orders""")
def p04(spark, sf):
    t, c = lambda n: table(spark, sf, n), F.col
    tables = {
        ("instagram", "comment"): t("conversations").select((c("conv_id") * 1000 + c("turn")).alias("comment_id"), F.concat(F.lit("https://www.instagram.com/p/s"), c("conv_id").cast("string"), F.lit("/")).alias("parent_permalink"), "text", c("role").alias("author_username")),
        ("instagram", "profile"): t("customer").select(c("c_custkey").alias("user_id"), c("c_name").alias("username")),
        ("youtube", "channel"): t("supplier").select(c("s_suppkey").alias("channel_id"), c("s_name").alias("handle"), c("s_name").alias("name")),
        ("youtube", "comment"): t("events").select(c("event_id").alias("comment_id"), F.when(c("event_id") % 2 == 0, "http://y/post").otherwise("http://y/watch?v=1").alias("target_url"), c("event_type").alias("author_name")),
        ("facebook", "comment"): t("orders").select(c("o_orderkey").alias("comment_id"), F.when(c("o_orderkey") % 2 == 0, F.concat(F.lit("http://f/p"), c("o_custkey").cast("string"))).alias("parent_permalink"), c("o_orderstatus").alias("author_name")),
    }
    return D.of_capture(tables, "c", F.lit(_CAPTURED).cast("timestamp")).select("id", "type", "url", F.array_join("author", "|").alias("author"), "wayback_date")


@query("p07_record_documents", _DOCS + """ SELECT '20240101000000/' || to_base64(unhex(md5('http://' || lang || '.example.com/' || doc_id))) AS id, CASE WHEN again THEN 'revisit' ELSE 'response' END AS record_type, lang || '.example.com' AS host, CASE WHEN n_chars < 100 THEN '404' ELSE '200' END AS status_code, '2024' AS crawl_year, 'text/plain' AS content_type_served,
  CASE WHEN NOT again THEN strlen(text) END AS content_length, 'sha1:' || sha1(text) AS hash, 'us' AS institution FROM d""")
def p07(spark, sf):
    rows = D.of_records(warc.captures(warc.read(spark, _written(spark, sf))), "us", "c")
    return rows.select("id", "record_type", "host", "status_code", "crawl_year", "content_type_served", "content_length", "hash", "institution")
