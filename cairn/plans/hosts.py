"""Queries of links, escapes and suffixes of hosts, and of documents on their way out."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from cairn.functions import images as I
from cairn.functions import signatures as G
from cairn.functions import urls as U
from cairn.operators import replay as R
from cairn.plans.catalog import Catalog
from cairn.plans.inputs import shared_folder, table
from cairn.sources.documents_out import write_documents

query = Catalog()
QUERIES, ORACLE = query.queries, query.sql


@query("f01_f07_resolved_links", r"""WITH p AS (SELECT page_id, url, regexp_extract(url, '^([a-z]+://[^/?#]*)', 1) AS root, string_split(regexp_extract(url, '^[a-z]+://[^/?#]*/([^?#]*)', 1), '/') AS parts FROM pages),
d AS (SELECT *, list_transform(range(0, 4), lambda k: '/' || array_to_string(parts[1:greatest(len(parts) - 1 - k, 0)] || [''], '/')) AS up FROM p)
SELECT page_id, root || CASE WHEN len(parts) > 1 THEN up[1] ELSE '/' END || 'a/' || page_id || '?x=../y#z' AS beside, root || CASE WHEN len(parts) > 2 THEN up[2] ELSE '/' END || 'b' AS above, root || CASE WHEN len(parts) > 3 THEN up[3] ELSE '/' END AS far,
  root || '/c' || page_id || '/' AS top, 'http://other.example/e' AS other, regexp_extract(url, '^[^?#]*') || '?q=' || page_id AS asked FROM d""")
def f01(spark, sf):
    p, u, k = table(spark, sf, "pages").select("page_id", "url"), F.col("url"), F.col("page_id").cast("string")
    link = lambda *parts: U.resolved(u, F.concat(*[F.lit(x) if isinstance(x, str) else x for x in parts]))
    return p.select("page_id", link("./a/x/../", k, "?x=../y#z").alias("beside"), link(" ../b ").alias("above"), link("../..").alias("far"), link("/d/./../../c", k, "/.").alias("top"), link("HTTP://other.example/../e").alias("other"), link("?q=", k).alias("asked"))


@query("f06_canonical_urls", r"""SELECT page_id, 'http://example.com/foo%20|%20bar/' || page_id || 'A-ros' || chr(233) || '%e6%bc%a2%25g%5c?a=' || page_id || '/b&p=x+y%23' AS canonical, 'http://example.com/' AS bare FROM pages""")
def f06(spark, sf):
    k = F.col("page_id").cast("string")
    url = F.concat(F.lit("https://WWW2.Example.com:443/foo | bar/"), k, F.lit("%41-ros%C3%A9漢%g\\?p=x y%23&a="), k, F.lit("%2Fb"))
    return table(spark, sf, "pages").select("page_id", U.canonical(url).alias("canonical"), U.canonical(F.lit("https://www.example.com:80//")).alias("bare"))


#: Rules of the kinds that a public suffix list has.
RULES = ("com", "jp", "co.jp", "*.kobe.jp", "!city.kobe.jp", "uk", "co.uk", "*.ck", "!www.ck")


@query("f11_host_suffixes", """WITH e(k, ending, public, labels) AS (VALUES (0, 'example.com', 'com', 1), (1, 'shop.co.jp', 'co.jp', 2), (2, 'a.b.kobe.jp', 'b.kobe.jp', 3), (3, 'x.city.kobe.jp', 'kobe.jp', 2), (4, 'www.ck', 'ck', 1), (5, 'y.zz.ck', 'zz.ck', 2), (6, 'else.where', 'where', 1), (7, 'x.co.uk', 'co.uk', 2)),
h AS (SELECT doc_id, source || '.' || lang || '.' || ending AS host, public, ending FROM documents JOIN e ON length(text) % 8 = k)
SELECT doc_id, host, public AS public_suffix, regexp_extract(ending, '([^.]+[.]' || replace(public, '.', '[.]') || ')$', 1) AS private_suffix FROM h""")
def f11(spark, sf):
    """Hosts of sources and languages under endings of each kind of rule."""
    endings = ("example.com", "shop.co.jp", "a.b.kobe.jp", "x.city.kobe.jp", "www.ck", "y.zz.ck", "else.where", "x.co.uk")
    ending = F.get(F.array(*map(F.lit, endings)), (F.length("text") % 8).cast("int"))
    d = table(spark, sf, "documents").select("doc_id", F.concat_ws(".", "source", "lang", ending).alias("host"))
    return U.with_suffixes(d, "host", spark.createDataFrame([(r,) for r in RULES], "rule string")).select("doc_id", "host", "public_suffix", "private_suffix")


@query("k10_k11_ud3_delivered_documents", """SELECT source, count(*) AS n, CAST(sum(doc_id) AS BIGINT) AS ids, CAST(sum(length(text)) AS BIGINT) AS chars FROM documents GROUP BY 1
UNION ALL SELECT 'xml', count(*), CAST(sum(s_suppkey) AS BIGINT), CAST(sum(length(s_name)) AS BIGINT) FROM supplier""")
def k10(spark, sf):
    """Documents go to files of their sources as JSON lines, suppliers to XML; both are read back."""
    folder = shared_folder(spark, "delivered")
    write_documents(table(spark, sf, "documents").select("doc_id", "source", "text"), f"{folder}/j", by="source", gzip=True)
    write_documents(table(spark, sf, "supplier").select("s_suppkey", "s_name"), f"{folder}/x", kind="xml")
    docs = spark.read.schema("doc_id long, text string").json(f"{folder}/j").select(F.regexp_extract(F.input_file_name(), "/([^/]*)-[0-9a-f]{32}[.]jsonl", 1).alias("source"), F.col("doc_id").alias("k"), F.length("text").alias("c"))
    field = lambda name: F.regexp_extract("value", f'<field name="{name}">([^<]*)</field>', 1)
    xml = spark.read.text(f"{folder}/x").where("value LIKE '<doc>%'").select(F.lit("xml").alias("source"), field("s_suppkey").cast("long").alias("k"), F.length(field("s_name")).alias("c"))
    return docs.unionByName(xml).groupBy("source").agg(F.count("*").alias("n"), F.sum("k").alias("ids"), F.sum(F.col("c").cast("long")).alias("chars"))


# ---- answers for addresses, formats ----------------------------------------------------------


def _captured(spark, sf):
    """Documents as records of their language's archive; those of 100 characters are pages."""
    c = F.col
    url = F.concat(F.lit("http://www."), "source", F.lit(".example.com/"), c("doc_id").cast("string"))
    return table(spark, sf, "documents").select(c("lang").alias("job"), c("doc_id").alias("nr"), url.alias("url"), R.is_page(F.lit("response"), F.when(c("n_chars") < 100, 404).otherwise(200), F.lit("text/html"), c("n_chars")).alias("page"))


@query("j17_replay_targets", """WITH c AS (SELECT lang AS job, doc_id AS nr, 'http://www.' || source || '.example.com/' || doc_id AS url, n_chars >= 100 AS page FROM documents),
f AS (SELECT job, arg_min(url, nr) FILTER (page) AS first FROM c GROUP BY 1)
SELECT nr, CASE WHEN nr % 4 = 0 THEN url || '#f' WHEN nr % 4 = 1 THEN url ELSE first END AS target, CASE nr % 4 WHEN 0 THEN 'exact' WHEN 1 THEN 'host-alias' WHEN 2 THEN 'fallback' ELSE 'auto' END AS reason FROM c JOIN f USING (job)""")
def j17(spark, sf):
    """Each record's address is asked for as it is, without www, for a page that isn't there, and not at all."""
    pages, k = _captured(spark, sf), F.col("nr") % 4
    asked = F.when(k == 0, F.concat("url", F.lit("#f"))).when(k == 1, F.replace("url", F.lit("//www."), F.lit("//"))).when(k == 2, F.concat("url", F.lit("/gone")))
    return R.targets(pages.select("job", "nr", asked.alias("url")), pages, "job", "nr").select("nr", "target", "reason")


@query("j18_archived_pages", "SELECT doc_id AS nr, CASE WHEN n_chars >= 100 THEN 'http://www.' || source || '.example.com/' || doc_id END AS page FROM documents")
def j18(spark, sf):
    pages = _captured(spark, sf)
    asked = pages.select("job", "nr", F.regexp_replace("url", "^http://www[.]([^/]*)", "https://$1:8080").alias("url"))
    return R.archived_pages(asked, pages.where("page"), "job", "nr").select("nr", "page")


@query("h22_formats", """SELECT page_id, [NULL, 'pdf', 'xml', 'webp', 'rtf'][page_id % 5 + 1] AS format, [NULL, 'application/pdf', 'application/xml', 'image/webp', 'application/rtf'][page_id % 5 + 1] AS mime, [NULL, 'signature', 'served', 'signature', 'signature'][page_id % 5 + 1] AS found_by FROM pages""")
def h22(spark, sf):
    """Pages with the first (and last) bytes of other formats, all served as XML."""
    k, lit = F.col("page_id") % 5, F.lit
    body = F.concat(F.when(k == 1, "\n%PDF-1.7 ").when(k == 2, '<?xml version="1.0"?>').when(k == 3, "RIFF1234WEBP").when(k == 4, "{\\rtf1 ").otherwise(""), "html", F.when(k == 4, "}\n").otherwise(""))
    f = G.identified(body, lit("Application/XML; charset=utf-8"))
    return table(spark, sf, "pages").select("page_id", f.alias("f")).select("page_id", "f.format", "f.mime", F.col("f.by").alias("found_by"))


def _drawn(batches):
    """Each vector as an image, and the same one brighter; the label says how many columns are added."""
    for frame in batches:
        rows = frame.to_pandas()
        grey = [np.clip(128 + 300 * np.pad(np.array(v, float).reshape(8, 8), ((0, 0), (0, n)), mode="edge"), 0, 200) for v, n in zip(rows["embedding"], rows["label"], strict=True)]
        yield pa.RecordBatch.from_arrays([frame.column(0), frame.column(1), pa.array([I.png(g) for g in grey], pa.binary()), pa.array([I.png(g + 50) for g in grey], pa.binary())], names=["vec_id", "label", "body", "brighter"])


@query("f66_h25_image_facts", "SELECT vec_id, 'png' AS kind, CAST(8 + label AS INT) AS width, CAST(8 AS INT) AS height, CAST((8 + label) * 8 AS BIGINT) AS pixels, CAST(vec_id AS BIGINT) AS alike FROM embeddings")
def f66_images(spark, sf):
    """Vectors drawn as grey images of 8 rows; a brighter copy of each has the same hash."""
    e = table(spark, sf, "embeddings").select("vec_id", "label", "embedding")
    drawn = e.mapInArrow(_drawn, "vec_id long, label int, body binary, brighter binary")
    facts = drawn.select("vec_id", I.image_facts("body").alias("f"), I.image_facts("brighter").alias("b"))
    return facts.select("vec_id", "f.kind", "f.width", "f.height", (F.col("f.width").cast("long") * F.col("f.height")).alias("pixels"), F.when(F.bit_count(F.col("f.hash").bitwiseXOR(F.col("b.hash"))) <= 4, F.col("vec_id")).alias("alike"))
