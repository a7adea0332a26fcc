"""Queries of scalar functions over pages, events and documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from cairn.functions import texts as X
from cairn.functions import times as D
from cairn.functions import urls as U
from cairn.plans.catalog import Catalog
from cairn.plans.inputs import table

query = Catalog()
QUERIES, ORACLE = query.queries, query.sql

#: A page's URL as other forms of it, so that rules for hosts and ports have work.
_FORMS = ("{u}", "https://User@WWW.{h}:443{p}#top", "http://ww2.{h}:8080{p}?b=2&utm_source=x&a", "{h}")


def forms(spark, sf):
    """(page_id, form, url)."""
    p = table(spark, sf, "pages").select("page_id", "url", F.regexp_extract("url", "^[a-z]+://([^/?#]*)", 1).alias("h"), F.regexp_extract("url", "^[a-z]+://[^/?#]*([^?#]*)", 1).alias("p"))
    made = [F.col("url"), F.concat(F.lit("https://User@WWW."), "h", F.lit(":443"), "p", F.lit("#top")), F.concat(F.lit("http://ww2."), "h", F.lit(":8080"), "p", F.lit("?b=2&utm_source=x&a")), F.col("h")]
    return p.select("page_id", F.posexplode(F.array(*made)).alias("form", "url"))


FORMS = r"""WITH p AS (SELECT page_id, url, regexp_extract(url, '^[a-z]+://([^/?#]*)', 1) AS h, regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1) AS p FROM pages),
f AS (SELECT page_id, 0 AS form, url FROM p UNION ALL SELECT page_id, 1, 'https://User@WWW.' || h || ':443' || p || '#top' FROM p
  UNION ALL SELECT page_id, 2, 'http://ww2.' || h || ':8080' || p || '?b=2&utm_source=x&a' FROM p UNION ALL SELECT page_id, 3, h FROM p),
a AS (SELECT *, lower(regexp_extract(url, '^([A-Za-z][A-Za-z0-9+.-]*)://', 1)) AS s, lower(regexp_replace(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1), '^.*@', '')) AS hp,
  regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)', 1) AS pa0, regexp_extract(url, '^[^?#]*\?([^#]*)', 1) AS q FROM f),
b AS (SELECT *, CASE WHEN pa0 = '' THEN '/' ELSE pa0 END AS pa, regexp_replace(hp, ':[0-9]*$', '') AS h, TRY_CAST(regexp_extract(hp, ':([0-9]+)$', 1) AS INTEGER) AS po,
  list_sort([CASE WHEN contains(x, '=') THEN x ELSE x || '=' END FOR x IN string_split(q, '&') IF x <> '']) AS qs FROM a)
"""


@query("f02_url_key", FORMS + r"""SELECT page_id, form, CASE WHEN hp = '' THEN url ELSE s || '://' || CASE WHEN po IS NULL OR (s = 'http' AND po = 80) OR (s = 'https' AND po = 443) THEN h ELSE hp END || pa ||
  CASE WHEN len([x FOR x IN qs IF NOT regexp_matches(lower(x), '^(utm_|fbclid|gclid|mc_cid|mc_eid|_ga)')]) > 0 THEN '?' || array_to_string([x FOR x IN qs IF NOT regexp_matches(lower(x), '^(utm_|fbclid|gclid|mc_cid|mc_eid|_ga)')], '&') ELSE '' END END AS key FROM b""")
def f02(spark, sf):
    return forms(spark, sf).select("page_id", "form", U.url_key(F.col("url")).alias("key"))


@query("f03_normalise_url", FORMS + r"""SELECT page_id, form, CASE WHEN hp = '' THEN url ELSE 'http://' || regexp_replace(h, '^(www[0-9]*|ww[0-9]?)\.', '') || CASE WHEN po IS NULL OR po IN (80, 443) THEN '' ELSE ':' || po END ||
  regexp_replace(pa, '(.)/+$', '\1') || CASE WHEN len(qs) > 0 THEN '?' || array_to_string(qs, '&') ELSE '' END END AS url_norm FROM b""")
def f03(spark, sf):
    return forms(spark, sf).select("page_id", "form", U.normalised(F.col("url")).alias("url_norm"))


@query("f04_f05_url_keys", FORMS + r"SELECT page_id, form, regexp_replace(h, '^www\.', '') AS host, pa AS path, q AS query, s AS scheme, hp AS hostport FROM b")
def f04(spark, sf):
    u = F.col("url")
    return forms(spark, sf).select("page_id", "form", U.replay_key(u).alias("r"), U.cli_key(u).alias("c")).select("page_id", "form", "r.*", "c.scheme", F.col("c.host").alias("hostport"))


@query("f09_f10_domains", FORMS + r"""SELECT page_id, form, h AS host, CASE WHEN len(string_split(h, '.')) <= 2 THEN h WHEN length(string_split(h, '.')[-1]) = 2 AND string_split(h, '.')[-2] IN ('com','co','org','net','gov','edu','ac')
  THEN array_to_string(string_split(h, '.')[-3:], '.') ELSE array_to_string(string_split(h, '.')[-2:], '.') END AS domain, array_to_string(string_split(h, '.')[-2:], '.') AS last_two FROM b""")
def f09(spark, sf):
    h = U.host(F.col("url"))
    return forms(spark, sf).select("page_id", "form", h.alias("host"), U.registrable(h).alias("domain"), U.last_two_labels(h).alias("last_two"))


@query("f12_host_levels", FORMS + r"""SELECT page_id, form, array_to_string([ '(' || array_to_string(list_reverse(string_split(h, '.'))[1:k], ',') || ',' FOR k IN range(1, len(string_split(h, '.')) + 1)], ' ') AS levels FROM b""")
def f12(spark, sf):
    return forms(spark, sf).select("page_id", "form", F.array_join(U.host_levels(U.host(F.col("url"))), " ").alias("levels"))


@query("f14_f15_resources", FORMS + r"""SELECT page_id, form, CASE WHEN regexp_matches(lower(pa), '^/?$|^/index\.[a-z]+$') THEN 'slashpage' WHEN lower(pa) = '/robots.txt' THEN 'robots' ELSE 'normal' END AS url_type,
  regexp_extract(pa, '([^/?&]*)(?:&.*)?$', 1) AS name, regexp_replace(lower(regexp_extract(regexp_extract(pa, '([^/?&]*)(?:&.*)?$', 1), '\.([^.]*)$', 1)), '[^0-9a-z]', '', 'g') AS ext FROM b""")
def f14(spark, sf):
    u = F.col("url")
    return forms(spark, sf).select("page_id", "form", U.url_type(u).alias("url_type"), U.resource_name(u).alias("name"), U.extension(u).alias("ext"))


@query("q01_q03_scope", FORMS + r"""SELECT page_id, form, h = 'ththre.example.com' AS same_host, array_to_string(string_split(h, '.')[-2:], '.') = 'example.com' AS same_domain,
  starts_with(url, 'http://ththre.example.com/fr/') AS below, regexp_matches(url, '(?:/fr/)|(?:/en/)') AND NOT regexp_matches(url, '(?:page=)') AS picked FROM b""")
def q01(spark, sf):
    u, seed = F.col("url"), "http://ththre.example.com/fr/"
    return forms(spark, sf).select(
        "page_id", "form", U.in_scope(u, seed).alias("same_host"), U.in_scope(u, seed, "same-domain").alias("same_domain"),
        U.in_scope(u, seed, "path-prefix").alias("below"), U.in_scope(u, seed, "any", ("/fr/", "/en/"), ("page=",)).alias("picked"),
    )


@query("p08_document_id", "SELECT event_id, strftime(ts, '%Y%m%d%H%M%S') || '/' || base64(unhex(md5(event_type))) AS id FROM events")
def p08(spark, sf):
    return table(spark, sf, "events").select("event_id", U.document_id(F.col("event_type"), D.wayback(F.col("ts")).cast("string")).alias("id"))


@query("f21_f22_names", r"""SELECT page_id, CASE WHEN n = '' THEN 'unnamed' ELSE n END AS file, regexp_replace(regexp_replace(lower(url), '[^a-z0-9]+', '-', 'g'), '^-|-$', '', 'g') AS slug FROM
 (SELECT *, substr(regexp_replace(regexp_replace(regexp_replace(url, '[<>:"/\\|?*\x00-\x1f\s]+', '-', 'g'), '-{2,}', '-', 'g'), '^[-. ]+|[-. ]+$', '', 'g'), 1, 120) AS n FROM pages)""")
def f21(spark, sf):
    return table(spark, sf, "pages").select("page_id", U.safe_filename(F.col("url")).alias("file"), U.slug(F.col("url")).alias("slug"))


# ---- times -----------------------------------------------------------------------


@query("f30_parse_time", """SELECT event_id, form, date_trunc('second', CASE WHEN form = 2 THEN date_trunc('day', ts) ELSE ts END) AS parsed FROM events, (SELECT unnest([0, 1, 2, 3]) AS form)
UNION ALL SELECT event_id, 4, NULL FROM events""")
def f30(spark, sf):
    ts = F.col("ts")
    texts = F.array(D.wayback(ts).cast("string"), F.unix_timestamp(ts).cast("string"), F.date_format(ts, "yyyyMMdd"), D.iso_utc(ts), F.lit("no date"))
    e = table(spark, sf, "events").select("event_id", F.posexplode(texts).alias("form", "text"))
    return e.select("event_id", "form", D.parse_time(F.col("text")).cast("timestamp_ntz").alias("parsed"))


@query("f31_f36_epochs", """SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%SZ') AS iso, CAST(strftime(ts, '%Y%m%d%H%M%S') AS BIGINT) AS wayback, strftime(ts, '%Y-%m-%dT%H:%M:%SZ') AS of_seconds, strftime(ts, '%Y-%m-%dT%H:%M:%SZ') AS of_millis, strftime(ts, '%Y') AS year FROM events""")
def f31(spark, sf):
    ts = F.col("ts")
    return table(spark, sf, "events").select(
        "event_id", D.iso_utc(ts).alias("iso"), D.wayback(ts).alias("wayback"), D.iso_utc(D.from_epoch(F.unix_timestamp(ts))).alias("of_seconds"),
        D.iso_utc(D.from_epoch(F.unix_timestamp(ts) * 1000)).alias("of_millis"), D.year_of(D.iso_utc(ts)).alias("year"),
    )


@query("f33_weekday_time", "SELECT event_id, date_trunc('second', ts) AS parsed FROM events")
def f33(spark, sf):
    ts = F.col("ts")
    text = F.concat(F.date_format(ts, "EEE MMM dd HH:mm:ss"), F.lit(" +0000 "), F.date_format(ts, "yyyy"))
    return table(spark, sf, "events").select("event_id", D.weekday_time(text).cast("timestamp_ntz").alias("parsed"))


@query("f34_snowflake_time", "SELECT event_id, make_timestamp(((event_id * 1000000007 >> 22) + 1288834974657) * 1000) AS at_ FROM events")
def f34(spark, sf):
    return table(spark, sf, "events").select("event_id", D.snowflake(F.col("event_id") * 1000000007).cast("timestamp_ntz").alias("at_"))


@query("f35_relative_time", "SELECT event_id, date_trunc('second', ts) - INTERVAL (1 + event_id % 7) DAY AS back FROM events")
def f35(spark, sf):
    text = F.concat((1 + F.col("event_id") % 7).cast("string"), F.lit(" days ago"))
    return table(spark, sf, "events").select("event_id", D.relative(text, F.col("ts")).cast("timestamp_ntz").alias("back"))


@query("f37_f38_wayback_digits", "SELECT event_id, date_trunc('minute', ts) AS of_12, date_trunc('second', ts) AS of_17, strftime(ts, '%Y') AS year FROM events")
def f37(spark, sf):
    ts = F.col("ts")
    return table(spark, sf, "events").select(
        "event_id", D.wayback_of(F.date_format(ts, "yyyyMMddHHmm")).cast("timestamp_ntz").alias("of_12"),
        D.wayback_of(F.date_format(ts, "yyyyMMddHHmmssSSS")).cast("timestamp_ntz").alias("of_17"), D.year_of(F.date_format(ts, "yyyyMMdd")).alias("year"),
    )


@query("f40_loose_date", "SELECT event_id, CAST(ts AS DATE) AS european, CAST(ts AS DATE) AS technical FROM events")
def f40(spark, sf):
    ts = F.col("ts")
    say = lambda p: D.loose_date(F.concat(F.lit("seen "), F.date_format(ts, p), F.lit(" there")))
    return table(spark, sf, "events").select("event_id", say("dd.MM.yyyy").alias("european"), say("yyyy-MM-dd").alias("technical"))


# ---- texts and numbers --------------------------------------------------------------


@query("f53_first_line", r"""SELECT doc_id, CASE WHEN length(l) > 120 THEN rtrim(substr(l, 1, 119), ' ') || '…' ELSE l END AS line, trim(regexp_replace(text, '\s+', ' ', 'g'), ' ') AS collapsed
FROM (SELECT *, trim(regexp_extract(text, '^\s*([^\n]*)', 1), ' ') AS l FROM documents)""")
def f53(spark, sf):
    return table(spark, sf, "documents").select("doc_id", X.first_line(F.col("text")).alias("line"), X.collapsed(F.col("text")).alias("collapsed"))


@query("f55_parse_count", """SELECT doc_id, n_chars AS plain, n_chars * 1000 + 200 AS thousands, CAST(NULL AS BIGINT) AS bad FROM documents""")
def f55(spark, sf):
    n = F.col("n_chars")
    return table(spark, sf, "documents").select("doc_id", X.parse_count(F.format_number(n, 0)).alias("plain"), X.parse_count(F.concat(n.cast("string"), F.lit(".2K"))).alias("thousands"), X.parse_count(F.lit("many")).alias("bad"))


@query("f57_digests", "SELECT doc_id, 'sha1:' || sha1(text) AS sha1, sha256(text) AS sha256, md5(text) AS md5 FROM documents")
def f57(spark, sf):
    return table(spark, sf, "documents").select("doc_id", X.sha1_digest(F.col("text")).alias("sha1"), F.sha2("text", 256).alias("sha256"), F.md5("text").alias("md5"))


@query("f58_base32", """WITH h AS (SELECT doc_id, sha1(text) AS x FROM documents), v AS (SELECT doc_id, list_transform(range(0, 8), lambda i: CAST('0x' || substr(x, CAST(i * 5 + 1 AS INTEGER), 5) AS INTEGER)) AS v FROM h)
SELECT doc_id, array_to_string(flatten(list_transform(v, lambda n: list_transform([15, 10, 5, 0], lambda s: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((n >> s) & 31) + 1, 1)))), '') AS digest FROM v""")
def f58(spark, sf):
    return table(spark, sf, "documents").select("doc_id", X.base32(F.sha1("text")).alias("digest"))


@query("f59_first_bytes", r"SELECT doc_id, CASE WHEN strlen(text) >= 4 THEN rtrim(regexp_replace(substr(lower(hex(encode(text))), 1, 64), '(..)', '\1 ', 'g'), ' ') END AS bytes FROM documents")
def f59(spark, sf):
    return table(spark, sf, "documents").select("doc_id", X.first_bytes(F.col("text")).alias("bytes"))


@query("h38_byte_shingles", r"""WITH t AS (SELECT doc_id, string_split(rtrim(regexp_replace(substr(lower(hex(encode(text))), 1, 64), '(..)', '\1 ', 'g'), ' '), ' ') AS t FROM documents WHERE strlen(text) >= 4),
k AS (SELECT *, unnest([4, 5, 6, 7]) AS k FROM t), g AS (SELECT doc_id, array_to_string(t[i:i + k - 1], ' ') AS shingle FROM (SELECT *, unnest(range(1, len(t) - k + 2)) AS i FROM k))
SELECT shingle, count(*) AS n, count(DISTINCT doc_id) AS docs FROM g GROUP BY 1""")
def h38(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", F.explode(X.byte_shingles(X.first_bytes(F.col("text")))).alias("shingle"))
    return d.groupBy("shingle").agg(F.count("*").alias("n"), F.countDistinct("doc_id").alias("docs"))


@query("f67_human_bytes", """SELECT doc_id, CASE WHEN n_chars < 1024 THEN n_chars || ' B' WHEN n_chars < 1048576 THEN format('{:.1f} KB', n_chars / 1024.0) ELSE format('{:.1f} MB', n_chars / 1048576.0) END AS size FROM documents""")
def f67(spark, sf):
    return table(spark, sf, "documents").select("doc_id", X.human_bytes(F.col("n_chars")).alias("size"))


@query("f71_sentence", "SELECT doc_id, upper(substr(source, 1, 1)) || substr(source, 2) AS said FROM documents")
def f71(spark, sf):
    return table(spark, sf, "documents").select("doc_id", X.sentence(F.col("source")).alias("said"))


@query("f65_sentiment_bucket", "SELECT event_id, CAST(greatest(0, least(4, floor(sign(value - 20) * ln(1 + abs(value - 20)) / 2.0 + 2.5))) AS INTEGER) AS bucket FROM events")
def f65(spark, sf):
    return table(spark, sf, "events").select("event_id", X.bucket_of(F.col("value") - 20).alias("bucket"))


@query("p11_field_adjuster", r"SELECT doc_id, nullif(substr(regexp_replace(trim(regexp_replace(regexp_replace(text, '[\x00-\x1f\x7f]', ' ', 'g'), '\s+', ' ', 'g'), ' '), 'the', 'THE', 'g'), 1, 524288), '') AS field FROM documents")
def p11(spark, sf):
    return table(spark, sf, "documents").select("doc_id", X.adjusted(F.col("text"), (("the", "THE"),), 512 * 1024).alias("field"))


@query("p12_kv_fields", "SELECT event_id, array_to_string(['type=' || event_type, 'value=' || CAST(CAST(value * 100 AS BIGINT) AS VARCHAR)], ';') AS kv FROM events")
def p12(spark, sf):
    return table(spark, sf, "events").select("event_id", F.array_join(F.array_compact(F.array(X.kv("type", F.col("event_type")), X.kv("value", F.round(F.col("value") * 100).cast("long")), X.kv("none", F.lit("")))), ";").alias("kv"))


@query("f62_f63_post_ids", "SELECT event_id, '1000000' || event_id AS first_, array_to_string(list_distinct_sorted, ' ') AS ids FROM (SELECT event_id, list_sort(list_distinct(['p' || event_id, '2000000' || (10 + event_id)])) AS list_distinct_sorted FROM events)")
def f62(spark, sf):
    e = F.col("event_id").cast("string")
    url = F.concat(F.lit("https://h/p/2000000"), (10 + F.col("event_id")).cast("string"), F.lit("/"))
    ids = X.aliases(F.concat(F.lit("p"), e), F.lit(None).cast("string"), url=url)
    return table(spark, sf, "events").select("event_id", X.first_id(F.concat(F.lit("at/12345/1000000"), e)).alias("first_"), F.array_join(F.array_sort(ids), " ").alias("ids"))
