"""Queries that write tables in the forms in which an archive gets them, and read them back."""

from __future__ import annotations

from pyspark.sql import functions as F

from cairn.functions import fuzzy
from cairn.functions import texts as X
from cairn.functions import urls as U
from cairn.operators import social_json as J
from cairn.plans.catalog import Catalog
from cairn.plans.inputs import shared_folder, table
from cairn.sources import files

query = Catalog()
QUERIES, ORACLE = query.queries, query.sql


@query("s05_json_lines", "SELECT event_id, event_type, value FROM events WHERE event_type <> 'error'")
def s05(spark, sf):
    """Events as JSON lines, with a blank line after each; those of errors break off."""
    folder = shared_folder(spark, "lines")
    line = F.to_json(F.struct("event_id", "event_type", "value"))
    table(spark, sf, "events").select(F.concat(F.when(F.col("event_type") == "error", F.left(line, F.lit(20))).otherwise(line), F.lit("\n"))).write.text(folder)
    return files.json_lines(spark, folder, "event_id long, event_type string, value double").where("event_id IS NOT NULL AND event_type IS NOT NULL")


@query("s06_json_objects", "SELECT c_custkey AS id, c_name AS name, c_mktsegment AS segment FROM customer WHERE c_mktsegment IS NOT NULL")
def s06(spark, sf):
    """Customers as objects over several lines, many in a file one after another in a list."""
    folder = shared_folder(spark, "objects")
    one = F.concat(F.lit('{\n "id": '), F.col("c_custkey").cast("string"), F.lit(',\n "name": '), F.to_json(F.struct("c_name")).substr(11, 10_000))
    rows = table(spark, sf, "customer").select("c_mktsegment", F.concat(F.regexp_replace(one, "\\}$", ""), F.lit(',\n "segment": "'), "c_mktsegment", F.lit('"\n}')).alias("o"), F.pmod(F.hash("c_custkey"), F.lit(8)).alias("part"))
    lists = rows.groupBy("c_mktsegment", "part").agg(F.concat(F.lit("["), F.array_join(F.collect_list("o"), ","), F.lit("]")).alias("value"))
    lists.write.partitionBy("c_mktsegment", "part").text(folder)
    return files.json_object(spark, folder, "id long, name string, segment string").select("id", "name", "segment")


@query("s07_json_maps", "SELECT source, CAST(doc_id AS VARCHAR) AS key, lang, n_chars AS n FROM documents")
def s07(spark, sf):
    """The documents of a source as one object of records by number, in parts of a source."""
    record = F.to_json(F.struct("lang", F.col("n_chars").alias("n")))
    entry = F.concat(F.lit('"'), F.col("doc_id").cast("string"), F.lit('":'), record)
    maps = table(spark, sf, "documents").groupBy("source", F.expr("doc_id div 1000")).agg(F.concat(F.lit("{"), F.array_join(F.collect_list(entry), ","), F.lit("}")).alias("m"))
    found = [files.json_map(maps.where(F.col("source").isNotNull()).select("m", "source"), "m", "struct<lang:string,n:long>")]
    named = table(spark, sf, "documents").select(F.col("doc_id").cast("string").alias("key"), "source")
    return found[0].join(named, "key").select("source", "key", "lang", "n")


@query("s08_k05_metadata_sheets", """SELECT CASE WHEN s_suppkey % 10 > 0 THEN 'http://s/' || s_suppkey END AS seed, pos, name, value FROM supplier, (VALUES (0, 'Title'), (1, 'Subject')) n(pos, name), LATERAL (SELECT CASE name WHEN 'Title' THEN s_name || ', "x"' ELSE 'n' || s_nationkey END AS value)""")
def s08(spark, sf):
    """Suppliers as a sheet: seeds with a title and a subject; every tenth is about the job itself. An empty column gives nothing."""
    folder = shared_folder(spark, "sheet")
    s = table(spark, sf, "supplier").select(F.when(F.col("s_suppkey") % 10 > 0, F.concat(F.lit("http://s/"), F.col("s_suppkey").cast("string"))).otherwise(" * ").alias("seed_url"), F.concat("s_name", F.lit(', "x"')).alias("Title"), F.concat(F.lit("n"), F.col("s_nationkey").cast("string")).alias("Subject"))
    files.csv_ready(s, ["seed_url", "Title", "Subject", "Empty"]).write.option("header", True).option("escape", '"').csv(folder)
    return files.metadata_sheet(spark, folder)


@query("s11_json_documents", "SELECT conv_id, turn, text, n FROM conversations, (VALUES (1), (2)) v(n)")
def s11(spark, sf):
    """Two values behind a guard with a broken line between them."""
    value = lambda n: F.to_json(F.struct("text", F.lit(n).alias("n")))
    c = table(spark, sf, "conversations").select("conv_id", "turn", F.concat(F.lit("for (;;);"), value(1), F.lit('\n{"broken": \n17 '), value(2)).alias("body"))
    return files.json_documents(c, "body").select("conv_id", "turn", F.get_json_object("json", "$.text").alias("text"), F.get_json_object("json", "$.n").cast("int").alias("n"))


@query("s12_s13_page_data", "SELECT page_id, '{\"id\":' || page_id || '}' AS embedded, CAST(page_id * 2 AS VARCHAR) AS assigned, 1 AS n FROM pages")
def s12(spark, sf):
    """Pages with data in a script of its own and in one that assigns it."""
    k = F.col("page_id")
    more = F.concat(F.lit('<head><script id="x" type="application/json">{"id":'), k.cast("string"), F.lit('}</script><script nonce="n">var ytInitialData = {"a":{"id":'), (k * 2).cast("string"), F.lit("}};</script>"))
    p = table(spark, sf, "pages").select("page_id", F.replace("html", F.lit("<head>"), more).alias("html"))
    found = files.embedded_json(F.col("html"))
    return p.select("page_id", found[0].alias("embedded"), F.get_json_object(files.assigned_json(F.col("html"), "ytInitialData"), "$.a.id").alias("assigned"), F.size(found).alias("n"))


@query("a21_folder_bytes", "SELECT CAST(sum(length(CAST(doc_id AS VARCHAR)) + 1) AS BIGINT) AS bytes FROM documents")
def a21(spark, sf):
    folder = shared_folder(spark, "bytes")
    table(spark, sf, "documents").select(F.col("doc_id").cast("string").alias("value")).write.text(f"{folder}/deep/er")
    return files.folder_bytes(spark, folder).select("bytes")


@query("k07_checksums", "SELECT sha256(string_agg(CAST(doc_id AS VARCHAR) || chr(10), '' ORDER BY doc_id)) AS sha256 FROM documents GROUP BY source, doc_id // 500")
def k07(spark, sf):
    """Checksums of files that hold the numbers of a source's documents.

    Each list is a file of one flat folder, not one in a folder of its own: those
    would be made, moved and listed one by one. All cores make files, as lists are
    short and would be put together in few tasks. Files move to their place as tasks
    end, under names that a repeated task gives again; a task without lists may
    leave an empty file.
    """
    folder = shared_folder(spark, "sums")
    lists = table(spark, sf, "documents").groupBy("source", F.expr("doc_id div 500").alias("part")).agg(F.array_join(F.transform(F.array_sort(F.collect_list("doc_id")), lambda x: x.cast("string")), "\n").alias("value"))
    dealt = lists.select("value", F.xxhash64("source", "part").alias("k")).repartition(2 * spark.sparkContext.defaultParallelism, "k").select("value")
    dealt.write.option("maxRecordsPerFile", 1).option("mapreduce.fileoutputcommitter.algorithm.version", 2).text(folder)
    return files.checksums(spark, folder).where(F.col("sha256") != F.sha2(F.lit("").cast("binary"), 256)).select("sha256")


@query("f16_f54_f69_texts", r"""SELECT doc_id, 'http://h/' || doc_id AS uri, lower(trim(regexp_replace(text, '\s+', ' ', 'g'), ' ')) AS canonical, lower(lang) || '-8' AS charset, CAST(doc_id AS VARCHAR) AS widest FROM documents""")
def f16(spark, sf):
    k = F.col("doc_id").cast("string")
    item = lambda width, u: F.struct(width.alias("width"), u.alias("u"))
    widest = X.widest(F.array(item(F.col("n_chars"), F.lit("small")), item(F.col("n_chars") + 1, k), item(F.lit(None).cast("long"), F.lit("none"))))
    return table(spark, sf, "documents").select("doc_id", U.header_value(F.concat(F.lit("<http://h/"), k, F.lit(">"))).alias("uri"), fuzzy.canonical(F.col("text")).alias("canonical"), X.charset(F.concat(F.lit("text/html; charset=\""), F.upper("lang"), F.lit('-8"; x=y'))).alias("charset"), widest["u"].alias("widest"))


@query("f86_continuation_tokens", "SELECT DISTINCT json_extract_string(props, '$.k') AS token FROM events UNION SELECT DISTINCT event_type FROM events")
def f86(spark, sf):
    """Tokens in payloads around events' own values, at two depths."""
    body = F.concat(F.lit('{"a":[{"continuation":"'), F.get_json_object("props", "$.k"), F.lit('"},{"b":{"token":"'), "event_type", F.lit('"}}],"token":null}'))
    return J.continuation_tokens(J.nodes(table(spark, sf, "events").select("event_id", body.alias("body")), "body"))
