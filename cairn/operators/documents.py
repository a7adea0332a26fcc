"""Search documents: locating records, validity, types, languages, links, annotations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cairn.functions import urls as U

#: Type buckets by what the content type starts with or has; the first that fits. Fixed values.
BUCKETS = (("image", "^image/"), ("audio", "^audio/"), ("video", "^video/"), ("html", "html"), ("pdf", "pdf"), ("word", "msword|wordprocessing|rtf"), ("excel", "excel|spreadsheet|csv"), ("powerpoint", "powerpoint|presentation"), ("text", "^text/"))


def nearest(rows: DataFrame, records: DataFrame, key: str, at: str, rank: list[str], width: int = 3600) -> DataFrame:
    """rows with the best record of their key: the smallest rank columns, then the nearest in time, then the earlier one, of equal ones the largest.

    Only the last record before and the first one at or after a row can be
    nearest within a rank. Time (at, in whole units) is cut into spans of width:
    windows look within a key's span, so a frequent key is many small windows,
    and what a span lacks comes from its neighbours, one row for each span.
    """
    kinds = records.select(key, *rank).distinct().groupBy(key).agg(F.min(F.struct(*rank)).alias("_r"))
    best = records.join(kinds, key).where(F.struct(*rank) == F.col("_r")).select(key, F.col(at).alias("_at"), F.struct(*records.columns).alias("_rec"), F.lit(None).cast(rows.schema).alias("_row"))
    asked = rows.select(key, F.col(at).alias("_at"), F.lit(None).cast(best.schema["_rec"].dataType).alias("_rec"), F.struct(*rows.columns).alias("_row"))
    both = best.unionByName(asked).withColumn("_is_row", F.col("_row").isNotNull()).withColumn("_span", F.floor(F.col("_at") / width))
    upto = lambda *order: W.partitionBy(key, "_span").orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    before, after = upto("_at", "_is_row", "_rec"), upto(F.desc("_at"), F.desc("_is_row"), "_rec")
    seen = both.withColumn("_b", F.last("_rec", True).over(before)).withColumn("_a", F.last("_rec", True).over(after)).where("_is_row")
    first, last = F.max_by("_rec", F.when(F.col("_rec").isNotNull(), F.struct(-F.col("_at"), "_rec"))), F.max_by("_rec", F.when(F.col("_rec").isNotNull(), F.struct("_at", "_rec")))
    spans = both.groupBy(key, "_span").agg(first.alias("_first"), last.alias("_last"))
    order = W.partitionBy(key).orderBy("_span")
    spans = spans.withColumn("_sb", F.last("_last", True).over(order.rowsBetween(W.unboundedPreceding, -1))).withColumn("_sa", F.first("_first", True).over(order.rowsBetween(1, W.unboundedFollowing)))
    seen = seen.join(spans.select(key, "_span", "_sb", "_sa"), [key, "_span"]).withColumn("_b", F.coalesce("_b", "_sb")).withColumn("_a", F.coalesce("_a", "_sa"))
    gap = lambda c: F.abs(F.col(f"{c}.{at}") - F.col("_at"))
    hit = F.when(F.col("_b").isNull() | (gap("_a") < gap("_b")), F.col("_a")).otherwise(F.col("_b"))
    return seen.select("_row.*", hit.alias("record"))


def type_bucket(mime: Column) -> Column:
    out = F.lit("other")
    for name, pattern in reversed(BUCKETS):
        out = F.when(F.lower(mime).rlike(pattern), F.lit(name)).otherwise(out)
    return out


def resolved_type(served: Column, found: Column, length: Column) -> Column:
    """What was detected, else what was served; nothing at all is its own type."""
    base = lambda c: F.nullif(F.lower(F.trim(F.split_part(c, F.lit(";"), F.lit(1)))), F.lit(""))
    return F.when(length == 0, "application/x-empty").otherwise(F.coalesce(F.when(base(found) != "application/octet-stream", base(found)), base(served), base(found), F.lit("application/octet-stream")))


def magic_type(data: Column) -> Column:
    """A type from the first bytes."""
    head = F.hex(F.substring(data.cast("binary"), 1, 8))
    return F.when(F.startswith(head, F.lit("255044462D")), "application/pdf").when(F.startswith(head, F.lit("89504E47")), "image/png").when(F.startswith(head, F.lit("FFD8FF")), "image/jpeg").when(F.startswith(head, F.lit("47494638")), "image/gif").when(F.startswith(head, F.lit("504B0304")), "application/zip").when(head.rlike("^3C(21|68|48)"), "text/html")


def text_kept(mime: Column, text: Column) -> Column:
    """No text for scripts and styles."""
    return F.when(~F.lower(mime).rlike("javascript|ecmascript|css"), text)


def problems(doc: DataFrame, integers: list[str], dates: list[str], required: str = "id") -> Column:
    """What makes a document invalid; empty if nothing does."""
    checks = [F.when(F.coalesce(F.col(required).cast("string"), F.lit("")) == "", F.lit(f"missing {required}"))]
    checks += [F.when(F.col(c).isNotNull() & F.col(c).cast("string").try_cast("long").isNull(), F.lit(f"{c} must be an integer")) for c in integers]
    checks += [F.when(F.col(c).isNotNull() & ~F.col(c).rlike(r"^[0-9]{4}-[0-9]{2}-[0-9]{2}T[0-9]{2}:[0-9]{2}:[0-9]{2}Z$"), F.lit(f"{c} must be a UTC time")) for c in dates]
    if "wayback_date" in doc.columns:
        checks.append(F.when(F.length(F.col("wayback_date").cast("string")) != 14, F.lit("wayback_date must have 14 digits")))
    return F.array_compact(F.array(*checks))


def links(html: Column) -> Column:
    """Distinct link targets in order."""
    return F.array_distinct(F.regexp_extract_all(html, F.lit(r'(?i)<a\s[^>]*?href="([^"]*)"'), 1))


def resolved_link(base: Column, link: Column) -> Column:
    """An absolute URL of a link; null for other schemes and for links within the page."""
    return F.when(~link.rlike(r"^\s*(?:#|$)"), U.resolved(base, link))


def host_edges(pages: DataFrame) -> DataFrame:
    """(src, dst, n): pages of a host with a link to another host or the same; pages: (url, html)."""
    edges = pages.select(U.host(F.col("url")).alias("src"), F.col("url").alias("_u"), F.explode(links(F.col("html"))).alias("link"))
    edges = edges.select("src", "_u", U.host(resolved_link(F.col("_u"), F.col("link"))).alias("dst")).where("dst <> ''").distinct()
    return edges.groupBy("src", "dst").agg(F.count("*").alias("n"))


def postcodes(text: Column) -> Column:
    """Distinct British postcodes of a text in order."""
    return F.array_distinct(F.regexp_extract_all(text, F.lit(r"\b([A-Z]{1,2}[0-9][0-9A-Z]? [0-9][A-Z]{2})\b"), 1))


#: Characters kept of a URL and of a document's content, as an indexer would; whole texts are used for everything else. Fixed values.
URL_CHARS, CONTENT_CHARS = 2048, 512 * 1024


def word_profiles(docs: DataFrame, label: str, most: int = 60) -> DataFrame:
    """(label, word): the most frequent words of each label; at most that many for each.

    Each of 64 parts of a label's vocabulary gives its own most frequent words
    first, so no task sorts a whole vocabulary.
    """
    words = docs.select(label, F.explode(F.split(F.lower("text"), r"[^\p{L}]+")).alias("word")).where("word <> ''")
    counts = words.groupBy(label, "word").agg(F.count("*").alias("n")).withColumn("_part", F.pmod(F.hash("word"), F.lit(64)))
    for keys in ([label, "_part"], [label]):
        counts = counts.withColumn("_i", F.row_number().over(W.partitionBy(*keys).orderBy(F.desc("n"), "word"))).where(F.col("_i") <= most)
    return counts.select(label, "word")


def language(docs: DataFrame, profiles: DataFrame, label: str = "lang", most: int = 20_000) -> DataFrame:
    """(doc_id, guess): the label whose profile has most of a text's words, ties by name; null for a text without any.

    profiles has a few words for each label. Up to most rows of it become sets
    that are asked where the text is; a larger table is joined with the words.
    """
    known = profiles.select(F.col(label).alias("guess"), "word").where("guess IS NOT NULL")
    rows = known.limit(most + 1).collect()
    words = F.split(F.lower("text"), r"[^\p{L}]+")
    best = lambda n, guess: F.struct(n.alias("n"), (-F.ascii(guess)).alias("a"), guess.alias("guess"))
    if len(rows) > most:
        hits = docs.select("doc_id", F.explode(words).alias("word")).join(known, "word").groupBy("doc_id", "guess").agg(F.count("*").alias("n"))
        found = hits.groupBy("doc_id").agg(F.max(best(F.col("n"), F.col("guess")))["guess"].alias("guess"))
        return docs.select("doc_id").join(found, "doc_id", "left")
    sets: dict[str, list[str]] = {}
    for r in rows:
        sets.setdefault(r.guess, []).append(r.word)
    if not sets:
        return docs.select("doc_id", F.lit(None).cast("string").alias("guess"))
    some = docs.select("doc_id", F.filter(words, lambda w: w.isin(*sorted({r.word for r in rows}))).alias("words"))
    among = lambda own: F.size(F.filter("words", lambda w: w.isin(*own)))
    scores = F.array(*[best(among(own), F.lit(guess)) for guess, own in sorted(sets.items())])
    return some.select("doc_id", F.when(F.size("words") > 0, F.array_max(scores)["guess"]).alias("guess"))


def nearest_colour(colours: DataFrame, named: DataFrame) -> DataFrame:
    """colours (r, g, b) with the name of the closest of few named ones, by the sum of differences; the first of equals.

    named (pos, name, r, g, b) is a table of a few hundred rows that becomes one
    array in each task.
    """
    table = named.agg(F.array_sort(F.collect_list(F.struct("pos", "name", "r", "g", "b"))).alias("_named")).withColumn("_k", F.lit(0))
    apart = lambda x: F.abs(x["r"] - F.col("r")) + F.abs(x["g"] - F.col("g")) + F.abs(x["b"] - F.col("b"))
    joined = colours.withColumn("_k", F.lit(0)).join(F.broadcast(table), "_k")
    return joined.withColumn("name", F.array_min(F.transform("_named", lambda x: F.struct(apart(x).alias("d"), x["pos"].alias("pos"), x["name"].alias("name"))))["name"]).drop("_named", "_k")


def annotated(pages: DataFrame, rules: DataFrame) -> DataFrame:
    """pages (url) with the distinct subjects of rules (scope, key, subject) that hold for them.

    resource: the URL itself; root: its host; subdomains: any suffix of its
    host. Suffixes are spread out, so all three are joins by equality.
    """
    keys = F.concat(
        F.array(F.struct(F.lit("resource").alias("scope"), F.col("url").alias("key")), F.struct(F.lit("root").alias("scope"), U.host(F.col("url")).alias("key"))),
        F.transform(U.host_levels(U.host(F.col("url"))), lambda k: F.struct(F.lit("subdomains").alias("scope"), k.alias("key"))),
    )
    spread = pages.select("url", F.explode(keys).alias("k")).select("url", "k.*")
    found = spread.join(rules, ["scope", "key"]).groupBy("url").agg(F.array_sort(F.collect_set("subject")).alias("subjects"))
    return pages.join(found, "url", "left").withColumn("subjects", F.coalesce("subjects", F.array().cast("array<string>")))


def under_prefix(pages: DataFrame, prefixes: DataFrame) -> DataFrame:
    """pages with allowed: whether a SURT prefix of their host is listed."""
    spread = pages.select("url", F.explode(U.host_levels(U.host(F.col("url")))).alias("prefix"))
    hit = spread.join(prefixes.select("prefix").distinct(), "prefix", "left_semi").select("url").distinct().withColumn("allowed", F.lit(True))
    return pages.join(hit, "url", "left").withColumn("allowed", F.coalesce("allowed", F.lit(False)))


def www_aliases(pages: DataFrame) -> DataFrame:
    """(alias, url): URLs that are missing on the other www form of a host that itself is there."""
    h = U.host(F.col("url"))
    own = pages.select("url", h.alias("host"), U.path(F.col("url")).alias("path"))
    hosts = own.select(F.col("host").alias("other")).distinct()
    asked = own.withColumn("other", U.toggled_www(F.col("host"))).join(hosts, "other", "left_semi")
    return asked.join(own.select(F.col("host").alias("other"), "path"), ["other", "path"], "left_anti").select(F.concat("other", "path").alias("alias"), "url")


def block_reason(marked: Column, title_body: Column, status: Column, phrases: tuple[str, ...]) -> Column:
    """Why a page counts as blocked: the header, a phrase, or the status, asked in this order."""
    said = F.lit(None).cast("string")
    for p in reversed(phrases):
        said = F.when(F.contains(F.lower(title_body), F.lit(p)), F.lit(f"phrase:{p}")).otherwise(said)
    return F.coalesce(F.when(marked, F.lit("header")), said, F.when(status.isin(403, 429, 503), F.concat(F.lit("status:"), status.cast("string"))))


def frontier(seeds: DataFrame, edges: DataFrame, depth: int, max_pages: int, materialise) -> DataFrame:
    """(url, depth) reached from seeds (url) over edges (src, dst) breadth first; materialise cuts the lineage of each step."""
    seen = materialise(seeds.select("url", F.lit(0).alias("depth")).distinct())
    edge = seen
    for d in range(1, depth + 1):
        new = edges.join(edge.select(F.col("url").alias("src")), "src").select(F.col("dst").alias("url")).distinct()
        edge = materialise(new.join(seen, "url", "left_anti").withColumn("depth", F.lit(d)))
        if edge.isEmpty():
            break
        seen = materialise(seen.unionByName(edge))
    return seen.orderBy("depth", "url").limit(max_pages)
