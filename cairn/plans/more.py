"""Queries of mappers, registries and choices."""

from __future__ import annotations

from pyspark.sql import functions as F

from cairn.functions import urls as U
from cairn.operators import mapping as M
from cairn.plans.catalog import Catalog
from cairn.plans.inputs import table

query = Catalog()
QUERIES, ORACLE = query.queries, query.sql


@query("p03_p06_o01_mapped_documents", """SELECT 'post:' || doc_id AS id, 'post' AS type, CAST(NULL AS VARCHAR) AS title, text, source AS author FROM documents
UNION ALL SELECT 'comment:' || (conv_id * 1000 + turn), CASE WHEN turn = 0 THEN 'comment' ELSE 'reply' END, NULL, text, role FROM conversations
UNION ALL SELECT 'profile:' || c_custkey, 'profile', c_name, c_mktsegment, NULL FROM customer""")
def p03(spark, sf):
    none = F.lit(None).cast("string")
    d = table(spark, sf, "documents").select(F.col("doc_id").alias("post_id"), none.alias("url"), "text", F.col("source").alias("author"), none.alias("created"))
    c = table(spark, sf, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("comment_id"), F.when(F.col("turn") > 0, F.col("conv_id")).alias("parent_id"), none.alias("url"), "text", F.col("role").alias("author"), none.alias("created"))
    p = table(spark, sf, "customer").select(F.col("c_custkey").alias("user_id"), none.alias("url"), F.col("c_name").alias("name"), F.col("c_mktsegment").alias("description"))
    return M.documents({"post": d, "comment": c, "profile": p}).select("id", "type", "title", "text", "author")


@query("p09_header_fields", "SELECT event_id, event_type AS type, CASE WHEN event_id % 2 = 1 THEN left(user_id || '-server', 5) END AS server FROM events")
def p09(spark, sf):
    h = F.array(F.struct(F.lit("content-TYPE").alias("name"), F.col("event_type").alias("value")), F.struct(F.lit("Content-Type").alias("name"), F.lit("second").alias("value")), F.struct(F.when(F.col("event_id") % 2 == 1, "SERVER").otherwise("x-server").alias("name"), F.concat(F.col("user_id").cast("string"), F.lit("-server")).alias("value")))
    return table(spark, sf, "events").select("event_id", M.header(h, "Content-Type", 200).alias("type"), M.header(h, "Server", 5).alias("server"))


@query("p17_ud7_enrichment", "SELECT doc_id, upper(source) AS source, length(lang) || '' AS size FROM documents")
def p17(spark, sf):
    def service(asked: list[dict]) -> list[dict]:
        return [{"name": a["s"].upper(), "size": str(len(a["l"]))} for a in asked]

    return M.enriched(table(spark, sf, "documents").select("doc_id", "source", "lang"), {"source": "s", "lang": "l"}, {"source": "name", "size": "size"}, service).drop("lang")


@query("ud1_h30_analysers", "SELECT doc_id, CASE WHEN lang = 'en' THEN length(text) END AS english_chars, CASE WHEN n_chars < 100 THEN text END AS short_text FROM documents")
def ud1(spark, sf):
    a = M.Analysers()
    a.register("english_chars", F.col("lang") == "en", F.length("text").cast("long"))
    a.register("short_text", F.col("n_chars") < 100, F.col("text"))
    a.register("off", F.lit(True), F.lit(1))
    return a.run(table(spark, sf, "documents"), "english_chars", "short_text").select("doc_id", "english_chars", "short_text")


@query("q04_robots", r"""WITH p AS (SELECT page_id, coalesce(nullif(regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1), ''), '/') AS pa FROM pages) SELECT page_id, NOT starts_with(pa, '/fr/') OR starts_with(pa, '/fr/8') AS allowed FROM p""")
def q04(spark, sf):
    p = table(spark, sf, "pages").select("page_id", "url")
    origins = p.select(F.concat(U.scheme(F.col("url")), F.lit("://"), U.hostport(F.col("url"))).alias("origin")).distinct()
    rules = origins.select("origin", F.explode(F.array(F.struct(F.lit(False).alias("allow"), F.lit("/fr/").alias("prefix")), F.struct(F.lit(True).alias("allow"), F.lit("/fr/8").alias("prefix")))).alias("r")).select("origin", "r.*")
    return M.robots_allowed(p, rules).select("page_id", "allowed")


@query("q15_q17_page_filters", r"""WITH p AS (SELECT page_id, regexp_extract(url, '^[a-z]+://([^/?#]*)', 1) AS h, coalesce(nullif(regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1), ''), '/') AS pa FROM pages)
SELECT page_id, regexp_matches(lower(pa), '^/?$|^/index\.[a-z]+$') AS slash, h = 'example.com' OR h LIKE '%.example.com' AS excluded FROM p""")
def q15(spark, sf):
    u = F.col("url")
    return table(spark, sf, "pages").select("page_id", (U.url_type(u) == "slashpage").alias("slash"), M.under_host(U.host(u), ("example.com",)).alias("excluded"))


@query("q22_promoted", "SELECT event_id, event_type = 'purchase' OR event_type LIKE 'cursor%' AS skipped FROM events")
def q22(spark, sf):
    k = F.col("event_type")
    return table(spark, sf, "events").select("event_id", M.promoted(F.when(k == "purchase", "promoted"), k).alias("skipped"))


@query("x09_best_media", "SELECT p_partkey, CASE WHEN p_size >= 20 THEN 'b' ELSE 'a' END AS best FROM part")
def x09(spark, sf):
    item = lambda kind, rate, name: F.struct(F.lit(kind).alias("type"), rate.cast("long").alias("bitrate"), F.lit(name).alias("name"))
    items = F.array(item("video/mp4", F.lit(19), "a"), item("video/mp4", F.col("p_size"), "b"), item("hls", F.lit(99), "c"))
    return table(spark, sf, "part").select("p_partkey", M.best_media(items)["name"].alias("best"))


@query("x11_search_order", "SELECT c_custkey, CASE WHEN c_custkey = 1 THEN 'id' WHEN lower(c_name) = 'x' THEN 'name' ELSE coalesce(NULL, CASE WHEN c_mktsegment = 'BUILDING' THEN 'slug' END) END AS found FROM customer")
def x11(spark, sf):
    c = table(spark, sf, "customer")
    by = M.first_match([(F.col("c_custkey").cast("string"), F.lit("id"))], F.lit("1"))
    return c.select("c_custkey", F.coalesce(by, M.first_match([(F.lower("c_name"), F.lit("name"))], F.lit("x")), M.first_match([(F.col("c_mktsegment"), F.lit("slug"))], F.lit("BUILDING"))).alias("found"))


@query("w12_thread_buckets", "SELECT event_id, 'data.' || user_id || '.edges.3.node' AS bucket FROM events")
def w12(spark, sf):
    path = F.concat(F.lit("data."), F.col("user_id").cast("string"), F.lit(".edges.3.node.edges."), F.col("event_id").cast("string"))
    return table(spark, sf, "events").select("event_id", M.thread_bucket(path).alias("bucket"))


@query("h15_redaction", r"""SELECT doc_id, regexp_replace(regexp_replace(text, '[A-Za-z0-9._]+@[A-Za-z0-9.]+', '[removed]', 'g'), '\+1 \(\d{3}\) \d{3}-\d{4}', '[removed]', 'g') AS text,
  array_to_string(list_filter([CASE WHEN regexp_matches(text, '[A-Za-z0-9._]+@[A-Za-z0-9.]+') THEN 'mail' END, CASE WHEN regexp_matches(text, '\+1 \(\d{3}\) \d{3}-\d{4}') THEN 'phone' END], lambda x: x IS NOT NULL), ',') AS changed FROM documents""")
def h15(spark, sf):
    r = M.redacted(F.col("text"), {"mail": r"[A-Za-z0-9._]+@[A-Za-z0-9.]+", "phone": r"\+1 \(\d{3}\) \d{3}-\d{4}"})
    return table(spark, sf, "documents").select("doc_id", r.alias("r")).select("doc_id", F.col("r.text").alias("text"), F.array_join("r.changed", ",").alias("changed"))


@query("h14_page_hold", "SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F')")
def h14(spark, sf):
    pages = table(spark, sf, "orders").select(F.col("o_orderkey").alias("l_orderkey"), (F.col("o_orderstatus") == "F").alias("accepted"))
    return M.held_back(table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber"), pages, "l_orderkey")


@query("f72_ud9_rewrite_rules", r"SELECT doc_id, CASE WHEN regexp_full_match(source, 'src1([0-9])') THEN regexp_replace(source, 'src1([0-9])', 'ten-\1') WHEN regexp_full_match(source, 'src([0-9])') THEN regexp_replace(source, 'src([0-9])', 'one-\1') END AS name FROM documents")
def f72(spark, sf):
    return table(spark, sf, "documents").select("doc_id", M.rewritten(F.col("source"), [("src1([0-9])", "ten-$1"), ("src([0-9])", "one-$1")]).alias("name"))


@query("o08_fallback_source", "SELECT doc_id, CASE WHEN quality IS NOT NULL THEN 'first' ELSE 'second' END AS served FROM documents LEFT JOIN labels USING (doc_id)")
def o08(spark, sf):
    first = table(spark, sf, "labels").select("doc_id")
    return M.fallback(first, table(spark, sf, "documents").select("doc_id"), "doc_id")


@query("u19_observation_merge", "SELECT user_id, event_type, max(CAST(round(value * 100) AS BIGINT)) AS weight, bool_or(value > 50) AS dear, count(*) AS seen_times FROM events GROUP BY 1, 2")
def u19(spark, sf):
    e = table(spark, sf, "events").select("user_id", "event_type", "event_id", F.round(F.col("value") * 100).cast("long").alias("weight"), (F.col("value") > 50).alias("dear"))
    return M.observed(e, ["user_id", "event_type"], "event_id", ["weight"], "dear").select("user_id", "event_type", "weight", "dear", "seen_times")


@query("a34_seed_stats", "SELECT l_orderkey AS seed, count(*) AS visited, count(*) FILTER (l_returnflag = 'R') AS failed, count(*) FILTER (l_linestatus = 'O') AS blocked FROM lineitem GROUP BY 1")
def a34(spark, sf):
    return table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("seed")).agg(F.count("*").alias("visited"), F.count_if(F.col("l_returnflag") == "R").alias("failed"), F.count_if(F.col("l_linestatus") == "O").alias("blocked"))


@query("a35_capture_manifest", "SELECT user_id, count(*) AS requested, count(*) FILTER (event_type <> 'error') AS reached, min(ts) AS first, max(ts) AS last, count(DISTINCT event_type) AS kinds FROM events GROUP BY 1")
def a35(spark, sf):
    return table(spark, sf, "events").groupBy("user_id").agg(F.count("*").alias("requested"), F.count_if(F.col("event_type") != "error").alias("reached"), F.min("ts").alias("first"), F.max("ts").alias("last"), F.countDistinct("event_type").alias("kinds"))


@query("j23_lookup", "SELECT s_suppkey, n_name AS place FROM supplier LEFT JOIN nation ON s_nationkey = n_nationkey")
def j23(spark, sf):
    places = table(spark, sf, "nation").select(F.col("n_nationkey").alias("s_nationkey"), F.col("n_name").alias("place"))
    return table(spark, sf, "supplier").join(places, "s_nationkey", "left").select("s_suppkey", "place")


@query("j27_media_of_posts", "SELECT o_orderkey AS post, l_linenumber AS media, p_name AS file FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey LEFT JOIN part ON p_partkey = l_partkey")
def j27(spark, sf):
    media = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("post"), F.col("l_linenumber").alias("media"), "l_partkey")
    files = table(spark, sf, "part").select(F.col("p_partkey").alias("l_partkey"), F.col("p_name").alias("file"))
    return table(spark, sf, "orders").select(F.col("o_orderkey").alias("post")).join(media, "post", "left").join(files, "l_partkey", "left").select("post", "media", "file")
