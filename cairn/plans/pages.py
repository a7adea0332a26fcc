"""Queries of pages, documents and themes."""

from __future__ import annotations

from pyspark.sql import functions as F

from cairn.functions import html as H
from cairn.functions import texts as X
from cairn.functions import urls as U
from cairn.operators import documents as O
from cairn.operators import theme as T
from cairn.plans.catalog import Catalog
from cairn.plans.inputs import table

query = Catalog()
QUERIES, ORACLE = query.queries, query.sql

THEME = T.Theme(name="harsh words", terms=("trash", "the", "loser", "der", "los"), exclude_terms=("scum", "moron"), url_include=("/src1[0-9]/",), url_exclude=("/src7/",), hub_patterns=("/src5/",), min_score=6)


def _docs(spark, sf):
    d = table(spark, sf, "documents")
    return d.select("doc_id", F.concat(F.lit("http://"), "lang", F.lit("/"), "source", F.lit("/")).alias("url"), T.read(THEME, T.normalised(F.split_part("text", F.lit("\n"), F.lit(1)))).alias("head"), T.read(THEME, F.col("lang")).alias("meta"), T.read(THEME, T.normalised(F.col("text"))).alias("body"))


_WORDCH = "[\\p{L}\\p{N}_]"


def _hits(col: str, term: str) -> str:
    """DuckDB has no lookaround: whole words are found among the text's words."""
    return f"len(list_filter(regexp_extract_all({col}, '{_WORDCH}+'), lambda x: regexp_full_match(x, '{term}(s|es|ed|ing)?')))"


_THEME = f"""WITH d AS (SELECT doc_id, 'http://' || lang || '/' || source || '/' AS url, trim(regexp_replace(lower(split_part(text, chr(10), 1)), '\\s+', ' ', 'g'), ' ') AS head, lang AS meta, trim(regexp_replace(lower(text), '\\s+', ' ', 'g'), ' ') AS body FROM documents),
h AS (SELECT *, CASE WHEN contains(url, '/src7/') THEN 'url' WHEN {_hits('head', 'scum')} > 0 THEN 'head:scum' WHEN {_hits('body', 'scum')} >= 3 THEN 'body:scum' WHEN {_hits('head', 'moron')} > 0 THEN 'head:moron' WHEN {_hits('body', 'moron')} >= 3 THEN 'body:moron' END AS hard,
  {", ".join(f"{_hits('head', t)} > 0 AS h{i}, {_hits('body', t)} AS b{i}" for i, t in enumerate(THEME.terms))} FROM d),
s AS (SELECT *, least(9, 3 * ({" + ".join(f"CAST(h{i} AS INT)" for i in range(5))})) AS head_points,
  least(5, {" + ".join(f"CASE WHEN h{i} AND {' + '.join([f'CAST(h{j} AS INT)' for j in range(i)]) or '0'} < 3 THEN 0 ELSE least(3, b{i}) END" for i in range(5))}) AS body_points FROM h),
v AS (SELECT *, CASE WHEN regexp_matches(url, '/src1[0-9]/') THEN 3 ELSE 0 END + head_points + body_points AS score FROM s)
"""


@query("h04_q26_theme_scores", _THEME + "SELECT doc_id, hard, CAST(score AS INTEGER) AS score, CASE WHEN hard IS NOT NULL THEN 'reject' WHEN score >= 6 THEN 'keep' WHEN score > 0 THEN 'unsure' ELSE 'reject' END AS decision FROM v")
def h04(spark, sf):
    return judged(spark, sf).select("doc_id", "hard", "score", "decision")


def judged(spark, sf):
    c = F.col
    d = _docs(spark, sf).withColumn("hard", T.hard_reason(THEME, c("url"), F.lit(None).cast("string"), c("head"), c("body")))
    d = d.withColumn("score", T.scores(THEME, c("url"), c("head"), c("meta"), c("body"))["score"])
    return d.withColumn("decision", T.verdict(THEME, c("hard"), c("score")))


@query("a09_a10_selection_counts", _THEME + ", w AS (SELECT *, CASE WHEN hard IS NOT NULL THEN 'reject' WHEN score >= 6 THEN 'keep' WHEN score > 0 THEN 'unsure' ELSE 'reject' END AS decision FROM v) SELECT count(*) FILTER (decision = 'keep') AS kept, count(*) FILTER (decision = 'unsure') AS unsure, count(*) FILTER (decision = 'reject') AS rejected FROM w")
def a09(spark, sf):
    n = lambda k: F.count_if(F.col("decision") == k)
    return judged(spark, sf).agg(n("keep").alias("kept"), n("unsure").alias("unsure"), n("reject").alias("rejected"))


_MODEL = "CASE toxic WHEN 1 THEN 'keep' WHEN 0 THEN 'reject' END"


@query("h06_q28_combined_verdicts", _THEME + f", w AS (SELECT v.*, {_MODEL} AS model, CASE WHEN hard IS NOT NULL THEN 'reject' WHEN score >= 6 THEN 'keep' WHEN score > 0 THEN 'unsure' ELSE 'reject' END AS r FROM v LEFT JOIN labels USING (doc_id)) SELECT doc_id, CASE WHEN model IS NOT NULL AND hard IS NULL THEN model ELSE r END AS decide, CASE WHEN model IS NOT NULL AND hard IS NULL AND r = 'unsure' THEN model ELSE r END AS tie_break, CASE WHEN model IS NULL OR hard IS NOT NULL OR model = r THEN r ELSE 'unsure' END AS agree, coalesce(CASE WHEN model IS NOT NULL AND hard IS NULL THEN model ELSE r END = 'keep', false) AS accepted FROM w")
def h06(spark, sf):
    model = table(spark, sf, "labels").select("doc_id", F.when(F.col("toxic") == 1, "keep").when(F.col("toxic") == 0, "reject").alias("model"))
    d, c = judged(spark, sf).join(model, "doc_id", "left"), F.col
    both = lambda p: T.combined(p, c("decision"), c("model"), c("hard").isNotNull())
    return d.select("doc_id", both("decide").alias("decide"), both("tie_break").alias("tie_break"), both("agree").alias("agree"), T.accepted(THEME, both("decide")).alias("accepted"))


@query("h05_h07_link_verdicts", f"WITH d AS (SELECT doc_id, 'http://' || lang || '/' || source || '/' AS url, trim(regexp_replace(lower(split_part(text, chr(10), 1)), '\\s+', ' ', 'g'), ' ') AS head FROM documents) SELECT doc_id, CASE WHEN contains(url, '/src7/') OR {_hits('head', 'scum')} > 0 OR {_hits('head', 'moron')} > 0 THEN 'skip' WHEN contains(url, '/src5/') THEN 'hub' WHEN regexp_matches(url, '/src1[0-9]/') OR " + " OR ".join(f"{_hits('head', t)} > 0" for t in THEME.terms) + " THEN 'fetch' ELSE 'unsure' END AS link FROM d")
def h05(spark, sf):
    return _docs(spark, sf).select("doc_id", T.link_verdict(THEME, F.col("url"), F.col("head.text")).alias("link"))


@query("h09_quotes_found", r"WITH d AS (SELECT doc_id, trim(regexp_replace(lower(text), '\s+', ' ', 'g'), ' ') AS t FROM documents) SELECT doc_id, 1 + CAST(contains(t, 'licensed under') AS INTEGER) + CAST(contains(t, 'the the') AS INTEGER) AS found FROM d")
def h09(spark, sf):
    d = table(spark, sf, "documents")
    quotes = F.array(F.substring("text", 1, 30), F.lit("Licensed  under"), F.lit("the the"), F.lit("a quote that no text has"))
    return d.select("doc_id", F.size(T.quotes_found(quotes, F.col("text"))).alias("found"))


# ---- documents ---------------------------------------------------------------------


@query("j07_w17_nearest_record", """WITH r AS (SELECT user_id, event_id, epoch_us(ts) // 1000000 AS seen, event_type <> 'view' AS rank FROM events WHERE event_type IN ('view', 'click')),
e AS (SELECT user_id, event_id AS id, epoch_us(ts) // 1000000 AS seen FROM events WHERE event_type = 'error')
SELECT e.id, arg_min(r.event_id, (r.rank, abs(r.seen - e.seen), r.seen, -r.event_id)) AS record FROM e LEFT JOIN r ON r.user_id = e.user_id GROUP BY 1""")
def j07(spark, sf):
    e = table(spark, sf, "events").withColumn("seen", F.unix_timestamp("ts"))
    records = e.where(F.col("event_type").isin("view", "click")).select("user_id", "event_id", "seen", (F.col("event_type") != "view").alias("rank"))
    asked = e.where("event_type = 'error'").select("user_id", F.col("event_id").alias("id"), "seen")
    return O.nearest(asked, records, "user_id", "seen", ["rank"]).select("id", F.col("record.event_id").alias("record"))


@query("q29_k09_valid_documents", """SELECT count(*) AS n, count(*) FILTER (length(CAST(y AS VARCHAR)) = 14) AS valid FROM (SELECT CASE WHEN n_chars < 100 THEN 2024 ELSE 20240101000000 + doc_id END AS y FROM documents)""")
def q29(spark, sf):
    d = table(spark, sf, "documents").select(F.col("doc_id").alias("id"), F.when(F.col("n_chars") < 100, 2024).otherwise(20240101000000 + F.col("doc_id")).alias("wayback_date"), F.col("n_chars").alias("content_length"), F.lit("2024-01-01T00:00:00Z").alias("crawl_date"))
    d = d.withColumn("problems", O.problems(d, ["content_length", "wayback_date"], ["crawl_date"]))
    return d.agg(F.count("*").alias("n"), F.count_if(F.size("problems") == 0).alias("valid"))


@query("h18_h19_content_types", """SELECT event_id, CASE event_type WHEN 'click' THEN 'text/html' WHEN 'view' THEN 'image/png' WHEN 'error' THEN 'application/x-empty' WHEN 'purchase' THEN 'application/pdf' ELSE 'application/octet-stream' END AS type,
 CASE event_type WHEN 'click' THEN 'html' WHEN 'view' THEN 'image' WHEN 'purchase' THEN 'pdf' ELSE 'other' END AS bucket FROM events""")
def h18(spark, sf):
    e, k = table(spark, sf, "events"), F.col("event_type")
    served = F.when(k == "click", "TEXT/HTML; charset=utf-8").when(k == "view", "image/jpeg").when(k == "purchase", "application/pdf")
    found = F.when(k == "view", "image/png").otherwise("application/octet-stream")
    kind = O.resolved_type(served, found, F.when(k == "error", 0).otherwise(1))
    return e.select("event_id", kind.alias("type"), O.type_bucket(kind).alias("bucket"))


@query("a11_documents_by_type", "SELECT lang AS type, count(*) AS n, count(*) FILTER (n_chars >= 100) AS located FROM documents GROUP BY 1")
def a11(spark, sf):
    return table(spark, sf, "documents").groupBy(F.col("lang").alias("type")).agg(F.count("*").alias("n"), F.count_if(F.col("n_chars") >= 100).alias("located"))


@query("a24_p19_host_edges", r"""WITH l AS (SELECT url, lower(regexp_extract(url, '^[a-z]+://([^/?#]*)', 1)) AS src, unnest(list_distinct(regexp_extract_all(html, '(?i)<a\s[^>]*?href="([^"]*)"', 1))) AS link FROM pages),
r AS (SELECT *, CASE WHEN regexp_matches(link, '^(?i)https?://') THEN lower(regexp_extract(link, '^[A-Za-z]+://([^/?#]*)', 1)) WHEN regexp_matches(link, '^[A-Za-z][A-Za-z0-9+.-]*:|^#|^$') THEN '' ELSE src END AS dst FROM l),
d AS (SELECT DISTINCT url, src, dst FROM r WHERE dst <> '') SELECT src, dst, count(*) AS n FROM d GROUP BY 1, 2""")
def a24(spark, sf):
    return O.host_edges(table(spark, sf, "pages").select("url", "html"))


@query("h28_postcodes", r"SELECT doc_id, len(list_distinct(regexp_extract_all(text, '\b([A-Z]{1,2}[0-9][0-9A-Z]? [0-9][A-Z]{2})\b', 1))) AS n FROM documents")
def h28(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.size(O.postcodes(F.col("text"))).cast("long").alias("n"))


_PROFILE = r"""WITH w AS (SELECT doc_id, lang, unnest(regexp_split_to_array(lower(text), '[^\p{L}]+')) AS word FROM documents),
p AS (SELECT lang AS guess, word FROM (SELECT lang, word, count(*) AS n FROM w WHERE word <> '' GROUP BY 1, 2) QUALIFY row_number() OVER (PARTITION BY lang ORDER BY n DESC, word) <= 60),
h AS (SELECT doc_id, guess, count(*) AS n FROM w JOIN p USING (word) GROUP BY 1, 2)"""


@query("h26_language", _PROFILE + ", b AS (SELECT doc_id, arg_max(guess, (n, -ascii(guess), guess)) AS guess FROM h GROUP BY 1) SELECT doc_id, guess FROM documents LEFT JOIN b USING (doc_id)")
def h26(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", "lang", "text")
    return O.language(d, O.word_profiles(d, "lang"))


_COLOURS = (("red", 255, 0, 0), ("green", 0, 128, 0), ("blue", 0, 0, 255), ("grey", 128, 128, 128), ("white", 255, 255, 255), ("black", 0, 0, 0))


@query("j24_nearest_colour", "WITH n AS (SELECT * FROM (VALUES " + ", ".join(f"({i}, '{n}', {r}, {g}, {b})" for i, (n, r, g, b) in enumerate(_COLOURS)) + ") t(pos, name, nr, ng, nb)), c AS (SELECT doc_id, n_chars % 256 AS r, (n_chars // 7) % 256 AS g, (n_chars // 49) % 256 AS b FROM documents) SELECT doc_id, arg_min(name, (abs(nr - r) + abs(ng - g) + abs(nb - b), pos)) AS name FROM c, n GROUP BY 1")
def j24(spark, sf):
    c = table(spark, sf, "documents").select("doc_id", (F.col("n_chars") % 256).alias("r"), (F.floor(F.col("n_chars") / 7) % 256).alias("g"), (F.floor(F.col("n_chars") / 49) % 256).alias("b"))
    named = spark.createDataFrame([(i, *x) for i, x in enumerate(_COLOURS)], "pos int, name string, r long, g long, b long")
    return O.nearest_colour(c, named).select("doc_id", "name")


@query("j19_j20_annotations", r"""WITH p AS (SELECT url, regexp_extract(url, '^[a-z]+://([^/?#]*)', 1) AS h FROM pages), f AS (SELECT min(url) AS u FROM pages)
SELECT url, array_to_string(list_filter([CASE WHEN h LIKE '%example.com' THEN 'all' END, CASE WHEN h = 'ththre.example.com' THEN 'host' END, CASE WHEN url = (SELECT u FROM f) THEN 'page' END], lambda x: x IS NOT NULL), ',') AS subjects FROM p""")
def j19(spark, sf):
    p = table(spark, sf, "pages").select("url")
    first = p.agg(F.min("url").alias("key")).select(F.lit("resource").alias("scope"), "key", F.lit("page").alias("subject"))
    rules = spark.createDataFrame([("root", "ththre.example.com", "host"), ("subdomains", "(com,example,", "all")], "scope string, key string, subject string").unionByName(first)
    return O.annotated(p, rules).withColumn("subjects", F.array_join("subjects", ","))


@query("j22_q14_surt_prefixes", "SELECT url, regexp_extract(url, '^[a-z]+://([^/?#]*)', 1) = 'ththre.example.com' AS allowed FROM pages")
def j22(spark, sf):
    return O.under_prefix(table(spark, sf, "pages").select("url"), spark.createDataFrame([("(com,example,ththre,",)], "prefix string"))


@query("j28_www_aliases", r"""WITH p AS (SELECT url, regexp_extract(url, '^[a-z]+://([^/?#]*)', 1) AS h, coalesce(nullif(regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1), ''), '/') AS pa FROM (SELECT url FROM pages UNION ALL SELECT DISTINCT 'http://www.' || regexp_extract(url, '^[a-z]+://([^/?#]*)', 1) || '/' FROM pages))
, t AS (SELECT *, CASE WHEN starts_with(h, 'www.') THEN substr(h, 5) ELSE 'www.' || h END AS o FROM p) SELECT o || pa AS alias, url FROM t WHERE o IN (SELECT h FROM p) AND NOT EXISTS (SELECT 1 FROM p WHERE p.h = t.o AND p.pa = t.pa)""")
def j28(spark, sf):
    p = table(spark, sf, "pages").select("url")
    www = p.select(F.concat(F.lit("http://www."), U.host(F.col("url")), F.lit("/")).alias("url")).distinct()
    return O.www_aliases(p.unionByName(www))


@query("q06_q07_block_detection", """SELECT doc_id, CASE WHEN source = 'src0' THEN 'header' WHEN contains(lower(text), 'licensed under') THEN 'phrase:licensed under' WHEN n_chars < 100 THEN 'status:403' END AS reason FROM documents""")
def q06(spark, sf):
    d = table(spark, sf, "documents")
    return d.select("doc_id", O.block_reason(F.col("source") == "src0", F.col("text"), F.when(F.col("n_chars") < 100, 403).otherwise(200), ("licensed under",)).alias("reason"))


@query("q08_q20_page_predicates", "SELECT page_id, page_id % 3 = 0 AS page, page_id % 4 <> 1 AS html FROM pages")
def q08(spark, sf):
    p, k = table(spark, sf, "pages"), F.col("page_id")
    served = F.when(k % 3 == 0, "Text/HTML; charset=utf-8").when(k % 3 == 1, "text/css")
    body = F.when(k % 4 == 1, F.concat(F.lit("%PDF-1.7 "), "html")).otherwise(F.col("html"))
    mime = F.lower(F.trim(F.split_part(served, F.lit(";"), F.lit(1))))
    return p.select("page_id", F.coalesce(mime.isin("text/html", "application/xhtml+xml"), F.lit(False)).alias("page"), (O.magic_type(body) == "text/html").alias("html"))


@query("p01_p02_search_documents", r"""SELECT doc_id, 'http://' || lang || '.example.com/' || doc_id AS url_norm, lang || '.example.com' AS host, 'example.com' AS domain, n_chars AS content_length, substr(text, 1, 524288) AS content, 'sha1:' || sha1(text) AS hash FROM documents""")
def p01(spark, sf):
    url = F.concat(F.lit("http://www."), "lang", F.lit(".example.com/"), F.col("doc_id").cast("string"), F.lit("/"))
    n = F.left(U.normalised(url), F.lit(O.URL_CHARS))
    return table(spark, sf, "documents").select("doc_id", n.alias("url_norm"), U.host(n).alias("host"), U.last_two_labels(U.host(n)).alias("domain"), F.col("n_chars").alias("content_length"), F.substring("text", 1, O.CONTENT_CHARS).alias("content"), X.sha1_digest(F.col("text")).alias("hash"))


@query("k19_p18_document_shape", "SELECT doc_id AS _id, coalesce(nullif(CASE WHEN lang = 'en' THEN '' ELSE lang END, ''), 'other') AS content_type_norm, lang || chr(9) || coalesce(NULL, '') || chr(9) || source AS formats FROM documents")
def k19(spark, sf):
    norm = F.when(F.col("lang") == "en", "").otherwise(F.col("lang"))
    return table(spark, sf, "documents").select(F.col("doc_id").alias("_id"), F.coalesce(F.nullif(norm, F.lit("")), F.lit("other")).alias("content_type_norm"), F.concat_ws("\t", "lang", F.lit(""), "source").alias("formats"))


# ---- HTML (Arrow functions; the SQL takes the given pages apart by patterns) -----------


def _unescaped(x: str) -> str:
    for name, char in (("copy", "©"), ("middot", "·"), ("lt", "<"), ("gt", ">"), ("quot", '"'), ("amp", "&")):
        x = f"regexp_replace({x}, '&{name};?', '{char}', 'g')"
    return x


def _lines(x: str) -> str:
    """Text of markup x: line elements begin and end lines, other tags vanish."""
    plain = _unescaped(f"regexp_replace(regexp_replace({x}, '</?({'|'.join(H.LINES)})( [^>]*)?>', chr(10), 'g'), '<[^>]*>', '', 'g')")
    return f"trim(regexp_replace(regexp_replace({plain}, '[ \\t\\x{{00A0}}]+', ' ', 'g'), '\\s*\\n\\s*', chr(10), 'g'), ' ' || chr(10))"


_NOISE = "<!--.*?-->|<script.*?</script>|<style.*?</style>"
_HREFS = """list_distinct(regexp_extract_all(html, '<(?:a href|img src)="([^"]+)"', 1))"""


@query("h01_page_fingerprint", rf"""WITH w AS (SELECT page_id, html, regexp_replace(regexp_replace(html, '{_NOISE}', ' ', 'gs'), '<[^>]*>', ' ', 'gs') AS words FROM pages)
SELECT page_id, 'sha1:' || sha1(trim(regexp_replace({_unescaped('words')}, '\s+', ' ', 'g')) || chr(10) || '--links--' || chr(10) || array_to_string(list_sort({_HREFS}), chr(10))) AS fingerprint FROM w""")
def h01(spark, sf):
    return H.fingerprints(table(spark, sf, "pages"), "html").select("page_id", "fingerprint")


@query("h03_s14_page_text", rf"""WITH b AS (SELECT page_id, html, regexp_replace(html, '{_NOISE}|<head>.*?</head>', '', 'gs') AS h FROM pages),
c AS (SELECT page_id, html, regexp_extract(h, '<article>(.*?)</article>', 1, 's') AS m, regexp_replace(h, '<nav>.*?(</nav>|$)|<footer>.*?(</footer>|$)', '', 'gs') AS b FROM b),
t AS (SELECT page_id, html, {_lines('m')} AS m, {_lines('b')} AS b FROM c), f AS (SELECT *, length(m) >= 200 OR m <> '' AND 10 * length(m) >= 3 * length(b) AS main_found FROM t)
SELECT page_id, trim({_unescaped("regexp_extract(html, '<title>(.*?)</title>', 1, 's')")}) AS title, trim({_unescaped("regexp_replace(regexp_extract(html, '<h1>(.*?)</h1>', 1, 's'), '<[^>]*>', '', 'g')")}) AS headline,
  'about ' || page_id AS description, CASE WHEN page_id % 3 = 0 THEN 'news' ELSE '' END AS section, CASE WHEN page_id % 3 = 0 THEN '2024-05-0' || (1 + page_id % 9) || 'T00:00:00Z' END AS published,
  regexp_extract(html, '<html lang="([a-z]+)', 1) AS lang, main_found, substr(CASE WHEN main_found THEN m ELSE b END, 1, {H.LONGEST}) AS text FROM f""")
def h03(spark, sf):
    """Every page gets a description, and every third one linked data with a section and a date."""
    data = F.concat(F.lit('<script type="application/ld+json">{"@graph": [{"articleSection": "news", "datePublished": "2024-05-0'), (1 + F.col("page_id") % 9).cast("string"), F.lit('"}]}</script>'))
    more = F.concat(F.lit('<head><meta name="Description" content="about '), F.col("page_id").cast("string"), F.lit('">'), F.when(F.col("page_id") % 3 == 0, data).otherwise(""))
    pages = table(spark, sf, "pages").select("page_id", F.replace("html", F.lit("<head>"), more).alias("html"))
    return H.page_texts(pages, "html").select("page_id", *[f"page.{c}" for c in ("title", "headline", "description", "section", "published", "lang", "main_found", "text")])


@query("h17_a25_html_features", rf"""WITH t AS (SELECT page_id, html, regexp_extract_all(regexp_replace(html, '<!--.*?-->|(<script>|<style>).*?(</script>|</style>)', '\1\2', 'gs'), '<([a-z][a-z0-9]*)', 1) AS e FROM pages)
SELECT page_id, array_to_string(list_sort({_HREFS}), ' ') AS links,
  array_to_string(list_sort(list_distinct(e || ['link', 'picture', 'source', 'img', 'link/@rel=license', 'meta/@name=', 'meta/@name=author'])), ' ') AS elements,
  '/l/' || page_id AS licenses, 'a' || page_id || '.png b,c.png d.png s.png' AS images FROM t""")
def h17(spark, sf):
    """Every page gets a license, an author and a picture of several sizes."""
    joined = lambda c: F.array_join(F.array_sort(f"features.{c}"), " ").alias(c)
    k = F.col("page_id").cast("string")
    more = F.concat(F.lit('<head><link rel="License" href="/l/'), k, F.lit('"><meta name="Author"><picture><source srcset="a'), k, F.lit('.png 1x, b,c.png 100w,\n d.png"><source><img srcset="s.png"></picture><source srcset="not.png">'))
    return H.features(table(spark, sf, "pages").select("page_id", F.replace("html", F.lit("<head>"), more).alias("html")), "html").select("page_id", *map(joined, ("links", "elements", "licenses", "images")))
