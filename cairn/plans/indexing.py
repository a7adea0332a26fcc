"""Queries of index runs, annotations, selection reports and streams that go on; documents, events and orders stand for their records."""

from __future__ import annotations

from pyspark.sql import functions as F

from cairn.functions import platforms as P
from cairn.operators import gates as G
from cairn.operators import indexing as I
from cairn.plans.catalog import Catalog
from cairn.plans.inputs import shared_folder, table, written
from cairn.sources import files, state
from cairn.streaming import states as S

query = Catalog()
QUERIES, ORACLE = query.queries, query.sql


# ---- captures and runs ------------------------------------------------------------------


@query("s15_platforms", "SELECT user_id, CASE WHEN bool_or(event_type = 'purchase' AND value > 45) THEN 'x' WHEN bool_or(event_type = 'click' AND value > 30) THEN 'facebook' WHEN bool_or(event_type = 'view' AND value > 30) THEN 'x' END AS platform FROM events GROUP BY 1")
def s15(spark, sf):
    k, v = F.col("event_type"), F.col("value")
    name = F.when((k == "purchase") & (v > 45), "x-manifest.json").when((k == "click") & (v > 30), "facebook-posts.jsonl").when((k == "view") & (v > 30), "x-posts.jsonl").otherwise("notes.txt")
    return I.platform_of(table(spark, sf, "events").select("user_id", name.alias("name")), "user_id", "name", ("facebook", "instagram", "x", "youtube"))


@query("s16_capture_times", """SELECT o_custkey, coalesce(min(o_orderdate) FILTER (o_orderstatus = 'F'), min(o_orderdate) FILTER (o_orderstatus = 'O'), TIMESTAMP '2030-01-01') AS at FROM orders GROUP BY 1""")
def s16(spark, sf):
    first = lambda s: F.min(F.when(F.col("o_orderstatus") == s, F.col("o_orderdate")))
    kind = dict(table(spark, sf, "orders").dtypes)["o_orderdate"]
    return table(spark, sf, "orders").groupBy("o_custkey").agg(first("F").alias("f"), first("O").alias("w")).select("o_custkey", I.capture_time(F.col("f"), F.col("w"), F.lit(None).cast(kind), F.lit("2030-01-01").cast(kind)).alias("at"))


@query("k12_f23_relocated", "SELECT doc_id, CASE WHEN n_chars >= 100 THEN '/new/root/' || source || '.warc.gz' END AS source_file_path FROM documents")
def k12(spark, sf):
    d = table(spark, sf, "documents").withColumn("source_file", F.when(F.col("n_chars") >= 100, F.concat("source", F.lit(".warc.gz"))))
    return I.relocated(d, F.lit("/new/root//")).select("doc_id", "source_file_path")


@query("k13_run_manifest", """WITH t AS (SELECT lang, count(*) AS n FROM documents GROUP BY 1)
SELECT count(*) AS documents, (SELECT string_agg(lang || '=' || n, ',' ORDER BY lang) FROM t) AS by_type, count(*) FILTER (n_chars >= 100) AS located, count(*) FILTER (n_chars < 100) AS unlocated, count(*) FILTER (source = 'src1') AS invalid FROM documents""")
def k13(spark, sf):
    m = I.run_manifest(table(spark, sf, "documents"), "lang", F.col("n_chars") >= 100, F.col("source") == "src1")
    return m.select("documents", F.array_join(F.transform(F.map_entries("by_type"), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string"))), ",").alias("by_type"), "located", "unlocated", "invalid")


@query("k10_a30_outputs_by_file", "SELECT source, count(*) AS documents FROM documents GROUP BY 1")
def k10(spark, sf):
    """Documents as gzipped JSON lines in a folder for each source file, and the lines of each folder counted."""
    folder = shared_folder(spark, "outputs")
    table(spark, sf, "documents").select("doc_id", "text", "source").repartition("source", F.col("doc_id") % 8).write.partitionBy("source").option("compression", "gzip").json(folder)
    lines = spark.read.text(folder)
    return lines.where(F.trim("value") != "").groupBy("source").agg(F.count("*").alias("documents"))


@query("k04_k15_appended_log", "SELECT event_type, count(*) AS n, max(event_id) AS last FROM events GROUP BY 1")
def k04(spark, sf):
    """Two appends to one log of JSON lines, read as a whole."""
    folder, e = shared_folder(spark, "log"), table(spark, sf, "events").select("event_id", "event_type")
    for late in (False, True):
        e.where((F.col("event_id") % 2 == 1) == F.lit(late)).write.mode("append").json(folder)
    return spark.read.schema("event_id long, event_type string").json(folder).groupBy("event_type").agg(F.count("*").alias("n"), F.max("event_id").alias("last"))


@query("k18_collection_run", """WITH j AS (SELECT source, count(*) AS documents, count(*) FILTER (n_chars >= 100) AS warcs, bool_or(n_chars > 19000) AS failed FROM documents GROUP BY 1)
SELECT CASE WHEN bool_or(failed AND warcs > 0) THEN 'failed' ELSE 'done' END AS status, count(*) FILTER (warcs > 0 AND NOT failed) AS done, count(*) FILTER (warcs = 0) AS skipped, count(*) FILTER (warcs > 0 AND failed) AS failed, CAST(sum(CASE WHEN warcs > 0 AND NOT failed THEN documents ELSE 0 END) AS BIGINT) AS documents FROM j""")
def k18(spark, sf):
    jobs = table(spark, sf, "documents").groupBy(F.col("source").alias("job")).agg(F.count("*").alias("documents"), F.count_if(F.col("n_chars") >= 100).alias("warcs"), F.bool_or(F.col("n_chars") > 19000).alias("failed"))
    return I.collection_run(jobs)


@query("p22_run_summaries", """SELECT o_orderkey, CASE WHEN died THEN 'failed' ELSE status END AS status, CASE WHEN died THEN 'stopped without finishing' END AS error, right(o_orderpriority, 4) AS detail FROM
(SELECT *, CASE o_orderstatus WHEN 'O' THEN 'running' ELSE 'done' END AS status, o_orderstatus = 'O' AND o_custkey % 2 = 0 AND o_orderkey % 100 > 60 AS died FROM orders)""")
def p22(spark, sf):
    c = F.col
    out = I.run_summary(F.when(c("o_orderstatus") == "O", "running").otherwise("done"), c("o_custkey") % 2 == 1, F.lit(0), c("o_orderkey") % 100, c("o_orderpriority"), most=4)
    return table(spark, sf, "orders").select("o_orderkey", out.alias("s")).select("o_orderkey", "s.*")


@query("a27_timing_tree", "SELECT user_id AS parent, event_type AS id, CAST(sum(CAST(round(value * 1000) AS BIGINT)) AS BIGINT) AS total, count(*) AS n FROM events GROUP BY 1, 2 QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY sum(CAST(round(value * 1000) AS BIGINT)) DESC, event_type) <= 2")
def a27(spark, sf):
    return I.timing_tree(table(spark, sf, "events").select(F.col("user_id").alias("parent"), F.col("event_type").alias("id"), F.round(F.col("value") * 1000).cast("long").alias("nanos")), 2).drop("place")


@query("a26_p20_parse_errors", "SELECT source, string_agg(DISTINCT e, '|' ORDER BY e) AS errors FROM (SELECT source, CASE WHEN n_chars < 100 THEN 'ParseError ' || lang || ': too short' ELSE 'ParseError: too long' END AS e FROM documents WHERE n_chars < 100 OR n_chars > 10000) GROUP BY 1")
def a26(spark, sf):
    d = table(spark, sf, "documents").where("n_chars < 100 OR n_chars > 10000")
    error = F.concat(F.lit("ParseError"), F.when(F.col("n_chars") < 100, F.concat(F.lit(" "), "lang")).otherwise(""), F.lit(": "), F.when(F.col("n_chars") < 100, "too short").otherwise("too long"))
    return d.groupBy("source").agg(F.array_join(F.array_sort(F.collect_set(error)), "|").alias("errors"))


@query("p10_p15_p16_projections", """SELECT o_orderkey, 'me' AS institution, nullif(o_orderstatus, '') AS title, CAST(o_custkey AS BIGINT) AS content_length, strftime(o_orderdate, '%Y%m%d%H%M%S') AS crawl_date, coalesce(string_agg(l_partkey || '.jpg', ',' ORDER BY l_linenumber, l_partkey), '') AS media FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY ALL""")
def p10(spark, sf):
    """Orders as posts with their lines as media, then as flat records with the institution's name."""
    o, k = table(spark, sf, "orders"), F.col
    posts = o.select("o_orderkey", F.lit("me").alias("institution"), F.array(k("o_orderstatus"), F.lit("other")).alias("title"), k("o_custkey").cast("string").alias("content_length"), k("o_orderdate").alias("crawl_date"), F.to_json(F.struct("o_orderkey")).alias("raw"))
    media = table(spark, sf, "lineitem").select(k("l_orderkey").alias("o_orderkey"), F.struct("l_linenumber", "l_partkey").alias("position"), F.concat(k("l_partkey").cast("string"), F.lit(".jpg")).alias("file"))
    both = G.posts_with_media(posts, media, "o_orderkey").withColumn("media", F.array(F.array_join("media_files", ","))).drop("media_files")
    return G.memento(both, ("content_length", "o_orderkey")).select("o_orderkey", "institution", "title", "content_length", "crawl_date", F.coalesce("media", F.lit("")).alias("media"))


@query("f42_last_modified", "SELECT event_id, CASE WHEN event_type = 'click' THEN strftime(ts, '%Y-%m-%d') WHEN value > 20 THEN user_id || '' ELSE props END AS at FROM events")
def f42(spark, sf):
    """Events' days as times of change, users as what metadata say, props as times of creation; what isn't there is empty or null."""
    e = table(spark, sf, "events")
    modified, stated = F.when(F.col("event_type") == "click", F.date_format("ts", "yyyy-MM-dd")).otherwise(""), F.when(F.col("value") > 20, F.col("user_id"))
    return e.select("event_id", G.last_modified(F.col("props"), stated, modified).alias("at"))


@query("h31_h32_text_and_revisits", "SELECT doc_id, CASE WHEN again THEN NULL WHEN lang = 'en' THEN NULL ELSE length(text) END AS content, CASE WHEN NOT again AND lang = 'en' THEN length(text) END AS text, CASE WHEN NOT again THEN n_chars END AS content_length, CASE WHEN again THEN source ELSE lang END AS content_type FROM (SELECT *, doc_id > min(doc_id) OVER (PARTITION BY text) AS again FROM documents)")
def h31(spark, sf):
    """Revisits carry no text and no length; of originals the English texts are indexed but not stored."""
    d = table(spark, sf, "documents")
    d = d.join(d.groupBy("text").agg(F.min("doc_id").alias("first")), "text")
    rows = d.select("doc_id", F.when(F.col("doc_id") > F.col("first"), "revisit").otherwise("response").alias("record_type"), F.col("text").alias("content"), F.col("n_chars").alias("content_length"), F.col("lang").alias("content_type"), F.col("source").alias("content_type_served"), "lang")
    out = G.with_stored_text(G.without_revisits(rows), True, F.col("lang") != "en")
    return out.select("doc_id", F.length("content").cast("long").alias("content"), F.length("text").cast("long").alias("text"), "content_length", "content_type")


@query("f66_f94_sizes_and_health", "SELECT p_partkey, p_size * (p_size + 1) AS pixels, CASE WHEN p_size > 0 THEN 100.0 * (p_size % 7) / p_size END AS free_percent FROM part")
def f66(spark, sf):
    s = F.col("p_size")
    return table(spark, sf, "part").select("p_partkey", (s * (s + 1)).alias("pixels"), F.when(s > 0, F.lit(100.0) * (s % 7) / s).alias("free_percent"))


# ---- annotations, selection ---------------------------------------------------------------


@query("j21_q34_annotations_by_pattern", "SELECT doc_id, array_to_string(list_filter([CASE WHEN regexp_matches(source, '[13]$') THEN 'odd' END, CASE WHEN contains(source, 'src1') THEN 'one' END], lambda x: x IS NOT NULL), ',') AS subjects, doc_id > 10 AND doc_id < 90 AS in_range FROM documents")
def j21(spark, sf):
    d = I.annotated_by_pattern(table(spark, sf, "documents"), "source", [("[13]$", "odd"), ("src1", "one")])
    return d.select("doc_id", F.array_join("subjects", ",").alias("subjects"), I.in_date_range(F.col("doc_id"), F.lit(10), F.lit(90)).alias("in_range"))


@query("s23_taxonomy_paths", "WITH RECURSIVE t AS (SELECT c_custkey AS id, CASE WHEN c_custkey > 4 THEN c_custkey // 4 END AS parent, c_name AS name FROM customer), r AS (SELECT id, name AS path FROM t WHERE parent IS NULL UNION ALL SELECT t.id, r.path || '/' || t.name FROM r JOIN t ON t.parent = r.id) SELECT * FROM r")
def s23(spark, sf):
    k = F.col("c_custkey")
    terms = table(spark, sf, "customer").select(k.alias("id"), F.when(k > 4, F.floor(k / 4)).alias("parent"), F.col("c_name").alias("name"))
    return I.taxonomy_paths(terms, 50, written)


@query("h11_link_chunks", """WITH RECURSIVE l AS (SELECT conv_id, turn, length(text) AS n, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS i FROM conversations),
r AS (SELECT conv_id, turn, i, n AS used, 0 AS chunk FROM l WHERE i = 1 UNION ALL SELECT l.conv_id, l.turn, l.i, CASE WHEN r.used + l.n > 900 THEN l.n ELSE r.used + l.n END, r.chunk + CASE WHEN r.used + l.n > 900 THEN 1 ELSE 0 END FROM r JOIN l ON l.conv_id = r.conv_id AND l.i = r.i + 1)
SELECT conv_id, turn, CAST(chunk AS INTEGER) AS chunk FROM r""")
def h11(spark, sf):
    return I.link_chunks(table(spark, sf, "conversations").withColumn("n", F.length("text")), "conv_id", "turn", "n", 100, 1000)


@query("h12_o04_selection_report", """WITH l AS (SELECT event_id AS i, CASE WHEN event_type IN ('view', 'click') THEN 'page' ELSE 'link' END AS kind, 'http://h/' || (event_id * 7 % 997) || '/' || user_id AS url, CASE WHEN value > 30 THEN 'skip' WHEN value > 10 THEN 'keep' ELSE 'unsure' END AS decision FROM events),
p AS (SELECT url, arg_max(decision, i) AS decision FROM l WHERE kind = 'page' GROUP BY 1), k AS (SELECT DISTINCT url FROM l WHERE kind = 'link' AND decision = 'skip' AND url NOT IN (SELECT url FROM p))
SELECT 'page' AS kind, decision, count(*) AS n FROM p GROUP BY 2 UNION ALL SELECT 'link', 'skip', count(*) FROM k""")
def h12(spark, sf):
    e, v = table(spark, sf, "events"), F.col("value")
    kind = F.when(F.col("event_type").isin("view", "click"), "page").otherwise("link")
    url = F.concat(F.lit("http://h/"), (F.col("event_id") * 7 % 997).cast("string"), F.lit("/"), F.col("user_id").cast("string"))
    log = e.select(F.col("event_id").alias("i"), kind.alias("kind"), url.alias("url"), F.when(v > 30, "skip").when(v > 10, "keep").otherwise("unsure").alias("decision"))
    pages, links = I.selection_report(log, "i")
    return pages.groupBy(F.lit("page").alias("kind"), "decision").agg(F.count("*").alias("n")).unionByName(links.agg(F.lit("link").alias("kind"), F.lit("skip").alias("decision"), F.count("*").alias("n")))


@query("j29_video_files", "SELECT user_id AS video, arg_min('media/' || event_id || '.mp4', event_id) AS file FROM events WHERE event_type IN ('view', 'click') AND value > 20 GROUP BY 1")
def j29(spark, sf):
    e = table(spark, sf, "events")
    name = F.concat(F.when(F.col("value") > 20, "media/").otherwise("thumbs/"), F.col("event_id").cast("string"), F.when(F.col("event_type") == "error", ".jpg").otherwise(".mp4"))
    return I.video_files(e.select(F.col("user_id").alias("video"), name.alias("file"), F.when(F.col("event_type").isin("view", "click", "error"), "video").otherwise("sound").alias("role"), F.col("event_id").alias("at")))


@query("s19_gallery_replay", "SELECT conv_id AS post, count(*) AS files, string_agg(turn || '', ',' ORDER BY turn) AS order_ FROM conversations WHERE turn > 0 GROUP BY 1")
def s19(spark, sf):
    """A log of messages in order: a post (2), then its files (3); each file belongs to the post before it in its log."""
    c = table(spark, sf, "conversations").where("turn >= 0")
    log = c.select(F.col("conv_id").alias("log"), F.col("turn").alias("at"), F.when(F.col("turn") == 0, 2).otherwise(3).alias("kind"), F.when(F.col("turn") == 0, F.col("conv_id")).alias("post"), F.col("turn").cast("string").alias("file"))
    return files.replayed(log, "log", "at").select("post", F.size("files").cast("long").alias("files"), F.array_join("files", ",").alias("order_")).where("files > 0")


@query("o02_warc_lists", "SELECT source, string_agg(n, ',' ORDER BY g, n) AS names FROM (SELECT DISTINCT source, lang || CASE WHEN n_chars < 100 THEN '.warc' ELSE '.warc.gz' END AS n, CASE WHEN n_chars < 100 THEN 1 ELSE 0 END AS g FROM documents) GROUP BY 1")
def o02(spark, sf):
    name = F.concat("lang", F.when(F.col("n_chars") < 100, ".warc").otherwise(".warc.gz"))
    names = table(spark, sf, "documents").groupBy("source").agg(F.collect_set(F.struct(F.endswith(name, F.lit(".warc")).alias("plain"), name.alias("name"))).alias("l"))
    return names.select("source", F.array_join(F.transform(F.array_sort("l"), lambda x: x["name"]), ",").alias("names"))


@query("f88_first_objects", "SELECT event_id, CASE WHEN event_id % 3 < 2 THEN event_id END AS id FROM events")
def f88(spark, sf):
    e = F.col("event_id").cast("string")
    prose = F.get(F.array(F.concat(F.lit("Sure! {not json} then {\"id\": "), e, F.lit(", \"x\": {\"y\": \"}\"}} end {\"id\": 0}")), F.concat(F.lit("```json\n{\"id\": "), e, F.lit("}\n```")), F.concat(F.lit("nothing { here "), e)), (F.col("event_id") % 3).cast("int"))
    return files.first_objects(table(spark, sf, "events").select("event_id", prose.alias("prose")), "prose").select("event_id", F.get_json_object("object", "$.id").cast("long").alias("id"))


@query("a36_progress_details", "SELECT user_id AS job, count(*) AS seen, count(*) FILTER (event_type = 'error') AS failed, count(DISTINCT event_type) AS kinds, CAST(max(event_id) AS BIGINT) AS last FROM events GROUP BY 1")
def a36(spark, sf):
    return table(spark, sf, "events").groupBy(F.col("user_id").alias("job")).agg(F.count("*").alias("seen"), F.count_if(F.col("event_type") == "error").alias("failed"), F.countDistinct("event_type").alias("kinds"), F.max("event_id").alias("last"))


# ---- streams -------------------------------------------------------------------------------


@query("st2_late_enrichment", "SELECT user_id, arg_min(event_type, event_id) FILTER (value > 40) AS kind, min(event_id) AS first_, count(DISTINCT event_type) AS kinds FROM events GROUP BY 1")
def st2(spark, sf):
    """Fragments of a record: the first value that is there fills a gap, whenever it comes; what is seen twice counts once."""
    e = S.events(spark, f"{sf}/events.parquet").withColumn("kind", F.when(F.col("value") > 40, F.col("event_type")))
    folder = shared_folder(spark, "stream")
    return S.upserted_stream(spark, S.enriched(e, "user_id", "event_id", "kind", "event_type"), "user_id", folder)


@query("st6_st11_resumed_tail", "SELECT event_type, count(*) AS n FROM events GROUP BY 1")
def st6(spark, sf):
    """A log that grows: what was there is read, the stream stops, more files come, and it goes on from its checkpoint without reading a row twice."""
    folder, e = shared_folder(spark, "tail"), table(spark, sf, "events").select("event_id", "event_type")
    for late in (0, 1):
        e.where(F.col("event_id") % 2 == late).write.mode("append").parquet(f"{folder}/in")
        out = S.drained(spark, spark.readStream.schema(e.schema).parquet(f"{folder}/in"), folder)
    return out.groupBy("event_type").agg(F.count("*").alias("n"))


@query("st5_sliding_budget", "WITH w AS (SELECT user_id, unnest([time_bucket(INTERVAL 30 MINUTE, ts) + INTERVAL 30 MINUTE, time_bucket(INTERVAL 30 MINUTE, ts) + INTERVAL 60 MINUTE]) AS e, CAST(round(value) AS BIGINT) AS v FROM events) SELECT user_id, e AS end_, CAST(sum(v) AS BIGINT) AS used FROM w WHERE e <= (SELECT max(ts) FROM events) GROUP BY 1, 2")
def st5(spark, sf):
    e = S.events(spark, f"{sf}/events.parquet").withColumn("amount", F.round("value").cast("long"))
    out = S.drained(spark, S.sliding(e, "ts", "60 minutes", "30 minutes", "0 seconds", "amount", "user_id"), shared_folder(spark, "stream"))
    return out.select("user_id", F.col("end").cast("timestamp_ntz").alias("end_"), "used")


# ---- small sources and choices ---------------------------------------------------------------


@query("s24_simulated_pages", "SELECT 'http://s/' || s_suppkey AS seed, 'http://s/' || s_suppkey || '#page' || n AS url, sha1('<html><body>page ' || n || ' of http://s/' || s_suppkey || '</body></html>') AS body FROM (SELECT s_suppkey, unnest(range(1, least(s_suppkey % 20, 12) + 1)) AS n FROM supplier)")
def s24(spark, sf):
    seeds = table(spark, sf, "supplier").select(F.concat(F.lit("http://s/"), F.col("s_suppkey").cast("string")).alias("url"), (F.col("s_suppkey") % 20).alias("max_pages"))
    return I.simulated_pages(seeds).select("seed", "url", F.sha1("body").alias("body"))


@query("h35_viewer_records", "SELECT kind, count(*) AS n FROM (SELECT CASE event_type WHEN 'view' THEN 'photo' WHEN 'click' THEN 'comment' ELSE 'post' END AS kind, value > 15 AS viewer FROM events) WHERE NOT (viewer AND kind = 'post') AND (viewer OR kind <> 'photo') GROUP BY 1")
def h35(spark, sf):
    kind = F.when(F.col("event_type") == "view", "photo").when(F.col("event_type") == "click", "comment").otherwise("post")
    e = table(spark, sf, "events").select(kind.alias("kind"), (F.col("value") > 15).alias("viewer"))
    return I.without_viewer_posts(e, F.col("viewer")).groupBy("kind").agg(F.count("*").alias("n"))


@query("k03_replaced_state", "SELECT user_id, max(event_id) AS last FROM events GROUP BY 1")
def k03(spark, sf):
    """A state as JSON that is replaced as a whole, the new version made from the one before."""
    folder, e = shared_folder(spark, "state"), table(spark, sf, "events").groupBy("user_id").agg(F.max("event_id").alias("last"))
    state.replace(e.withColumn("last", F.col("last") - 1), folder)
    state.replace(state.read(spark, folder, "user_id long, last long").withColumn("last", F.col("last") + 1), folder)
    return state.read(spark, folder, "user_id long, last long")
