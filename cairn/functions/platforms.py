"""Addresses, requests, payload fields and metadata of social platforms and indexes, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

def _part(text: Column, pattern: str, k: int = 1) -> Column:
    """A group of a pattern, or null if the pattern isn't there or the group is empty."""
    return F.nullif(F.regexp_extract(text, pattern, k), F.lit(""))


# ---- addresses ---------------------------------------------------------------


def original_image(url: Column) -> Column:
    """Requests for an image in its original size, the best first; only the URL itself for what isn't an image's."""
    plain = F.regexp_extract(url, r"^([^?#]*)", 1)
    stem, kind = _part(plain, r"(?i)^(.*)\.(?:jpg|jpeg|png|webp|gif)$"), F.lower(_part(plain, r"(?i)\.(jpg|jpeg|png|webp|gif)$"))
    kind = F.when(kind == "jpeg", "jpg").otherwise(kind)
    sized = [F.concat(stem, F.lit("?format="), kind, F.lit("&name="), F.lit(n)) for n in ("orig", "4096x4096", "large")]
    return F.when(stem.isNull(), F.array(url)).otherwise(F.array(*sized, url))


#: Hosts of X and its own pages, which aren't accounts. Fixed values.
X_HOSTS = ("x.com", "www.x.com", "mobile.x.com", "twitter.com", "www.twitter.com", "mobile.twitter.com")
X_RESERVED = (
    "home", "explore", "notifications", "messages", "i", "settings", "search", "hashtag", "login", "logout", "compose", "intent", "share", "account",
    "tos", "privacy", "about", "jobs", "signup", "flow", "communities", "lists", "bookmarks", "premium", "verified-choose",
)
X_TABS = ("with_replies", "media", "highlights", "likes", "articles")


def x_target(raw: Column, reserved: tuple[str, ...] = X_RESERVED) -> Column:
    """struct(kind, key) of a handle, profile, post, hashtag or search; null for anything else, and for reserved names."""
    text = F.trim(raw)
    made = lambda kind, key: F.struct(F.lit(kind).alias("kind"), key.alias("key"))
    bare = ~F.contains(text, F.lit("/")) & ~F.contains(text, F.lit("?"))
    searched = F.nullif(F.trim(F.regexp_replace(text, "(?i)^search:", "")), F.lit(""))
    handle = F.regexp_replace(text, "^@+", "")
    is_handle = lambda h: h.rlike("^[A-Za-z0-9_]{1,15}$") & ~F.lower(h).isin(*reserved)
    full = F.when(F.contains(text, F.lit("://")), text).otherwise(F.concat(F.lit("https://"), text))
    host = F.lower(F.regexp_extract(full, r"^[a-zA-Z]+://([^/?#:]*)", 1))
    parts = F.filter(F.split(F.regexp_extract(full, r"^[a-zA-Z]+://[^/?#]*([^?#]*)", 1), "/"), lambda p: p != "")
    one, two, three, n = F.get(parts, F.lit(0)), F.get(parts, F.lit(1)), F.get(parts, F.lit(2)), F.size(parts)
    head = F.lower(one)
    asked = F.nullif(F.trim(F.try_url_decode(F.regexp_extract(full, r"[?&]q=([^&#]*)", 1))), F.lit(""))
    by_url = (
        F.when(head == "search", F.when(asked.isNotNull(), made("search", asked)))
        .when((head == "hashtag") & (n >= 2), made("search", F.concat(F.lit("#"), F.try_url_decode(two))))
        .when((head == "i") & (n >= 3) & two.isin("status", "web"), F.when(three.rlike("^[0-9]+$"), made("post", three)))
        .when(~is_handle(one), F.lit(None))
        .when((n >= 3) & (two == "status"), F.when(three.rlike("^[0-9]+$"), made("post", three)))
        .when((n == 1) | ((n == 2) & two.isin(*X_TABS)), made("profile", one))
    )
    return (
        F.when(text.rlike("(?i)^search:"), F.when(searched.isNotNull(), made("search", searched)))
        .when(F.startswith(text, F.lit("#")) & bare & ~F.contains(text, F.lit(" ")), F.when(text.rlike(r"(?U)^#\w{1,100}$"), made("search", text)))
        .when(bare & ~F.contains(text, F.lit("://")), F.when(is_handle(handle), made("profile", handle)))
        .when(host.isin(*X_HOSTS), by_url)
    )


#: What a path of a single Facebook post has. Fixed values.
POST_PATHS = ("/posts/", "/permalink/", "/permalink.php", "/videos/", "/photo", "/story.php", "/watch", "/reel/")


def facebook_target(url: Column) -> Column:
    """struct(kind, post_id): whether an address is a post's or a page's, and the id in it: a query value, the last number in the path, or what follows a marker."""
    path, query = F.regexp_extract(url, r"^[a-zA-Z]+://[^/?#]*([^?#]*)", 1), F.regexp_extract(url, r"\?([^#]*)", 1)
    low = F.lower(path)
    is_post = F.lit(False)
    for marker in POST_PATHS:
        is_post = is_post | F.contains(low, F.lit(marker))
    is_post = ~F.contains(low, F.lit("/groups/")) & (is_post | F.lower(query).rlike("fbid="))
    values = [F.nullif(F.trim(_part(query, rf"(?:^|&){k}=([^&]*)")), F.lit("")) for k in ("story_fbid", "fbid", "post_id", "v")]
    numbers = F.filter(F.split(path, "/"), lambda p: p.rlike("^[0-9]+$"))
    named = [_part(path, rf"(?:^|/){m}/+([^/]+)") for m in ("posts", "permalink", "videos")]
    return F.struct(F.when(is_post, "post").otherwise("page").alias("kind"), F.coalesce(*values, F.get(numbers, F.size(numbers) - 1), *named).alias("post_id"))


def graphql_request(url: Column) -> Column:
    """struct(operation, query_id, user_id, query, focal_id, cursor) of a GraphQL address with its variables; null for other addresses."""
    at = r"/i/api/graphql/([^/?#]+)/([A-Za-z0-9_]+)/?(?:[?#]|$)"
    variables = F.try_url_decode(F.regexp_extract(url, r"[?&]variables=([^&#]*)", 1))
    get = lambda k: F.get_json_object(variables, f"$.{k}")
    found = F.struct(_part(url, at, 2).alias("operation"), _part(url, at, 1).alias("query_id"), get("userId").alias("user_id"), get("rawQuery").alias("query"), F.coalesce(get("focalTweetId"), get("tweetId")).alias("focal_id"), get("cursor").alias("cursor"))
    return F.when(url.rlike(at), found)


def source_path(root: Column, name: Column) -> Column:
    """Where a source file is: the root without slashes at its end, and the name; the name alone without a root."""
    top = F.regexp_replace(F.coalesce(root, F.lit("")), r"[/\\]+$", "")
    return F.when(top == "", name).otherwise(F.concat(top, F.lit("/"), name))


# ---- payload fields ------------------------------------------------------------


def text_of(node: Column) -> Column:
    """The text of a JSON node: a string, simpleText, the runs joined, or content; null if nothing is left."""
    runs = F.from_json(F.get_json_object(node, "$.runs"), "array<struct<text:string>>")
    joined = F.array_join(F.transform(runs, lambda r: F.coalesce(r["text"], F.lit(""))), "")
    own = F.when(node.rlike(r"^\s*\{"), F.coalesce(F.get_json_object(node, "$.simpleText"), joined, F.get_json_object(node, "$.content"))).otherwise(F.get_json_object(F.concat(F.lit('{"x":'), node, F.lit("}")), "$.x"))
    return F.nullif(F.trim(own), F.lit(""))


def relay_id(value: Column) -> Column:
    """struct(kind, id) of a base64 global id: comments, posts by their feedback, stories; null for anything else."""
    padded = F.rpad(value, (F.ceil(F.length(value) / 4) * 4).cast("int"), F.lit("="))
    text = F.when(value.rlike("^[A-Za-z0-9+/]{12,}={0,2}$"), F.try_to_binary(padded, F.lit("base64")).cast("string"))
    tail = lambda pattern: _part(text, pattern)
    made = lambda kind, key: F.when(key.isNotNull(), F.struct(F.lit(kind).alias("kind"), key.alias("id")))
    return (
        F.when(F.startswith(text, F.lit("comment:")), made("comment", tail(r"^comment:(?:.*_)?([^_]+)$")))
        .when(F.startswith(text, F.lit("feedback:")), made("post", tail(r"^feedback:([^_]+)")))
        .when(F.startswith(text, F.lit("S:")), made("story", tail(r"^S:(?:.*:)?([^:]+)$")))
    )


def entities(legacy: Column, note: Column) -> Column:
    """struct(urls, tags, mentions) of two JSON objects, those of the note first; each once, in order."""

    def of(node: Column, top: str, kind: str, field: str) -> Column:
        items = F.from_json(F.get_json_object(node, f"$.{top}.{kind}"), f"array<struct<{field}:string>>")
        return F.coalesce(F.filter(F.transform(items, lambda x: x[field]), lambda x: F.coalesce(x, F.lit("")) != ""), F.array().cast("array<string>"))

    both = lambda kind, field: F.array_distinct(F.concat(of(note, "entity_set", kind, field), of(legacy, "entities", kind, field)))
    return F.struct(both("urls", "expanded_url").alias("urls"), both("hashtags", "text").alias("tags"), both("user_mentions", "screen_name").alias("mentions"))


def _plain_key(key: Column) -> Column:
    return F.lower(F.replace(key, F.lit("_"), F.lit("")))


def lookup(node: Column, keys: tuple[str, ...]) -> Column:
    """The first value among keys of a JSON object: by exact name, else whatever the case and underscores; empty values don't count."""
    own = F.map_filter(F.from_json(node, "map<string,string>"), lambda _, v: v.isNotNull() & ~v.isin("", "[]", "{}"))
    loose = F.map_entries(own)
    return F.coalesce(*[F.try_element_at(own, F.lit(k)) for k in keys], *[_alike(loose, k) for k in keys])


def _alike(entries: Column, key: str) -> Column:
    return F.get(F.filter(entries, lambda e: _plain_key(e["key"]) == key.replace("_", "").lower()), F.lit(0))["value"]


def find_value(node: Column, keys: tuple[str, ...], depth: int = 3) -> Column:
    """lookup in an object, then in the objects inside it, level by level; of lists the first 20 items."""
    level, found = F.array(node), []
    is_object = lambda x: F.startswith(F.coalesce(x, F.lit("")), F.lit("{"))

    def inside(x: Column) -> Column:
        lists = lambda v: F.when(F.startswith(F.coalesce(v, F.lit("")), F.lit("[")), F.slice(F.from_json(v, "array<string>"), 1, 20)).otherwise(F.array(v))
        return F.filter(F.flatten(F.transform(F.map_values(F.from_json(x, "map<string,string>")), lists)), is_object)

    for _ in range(depth + 1):
        found.append(F.get(F.filter(F.transform(level, lambda x: lookup(x, keys)), lambda x: x.isNotNull()), F.lit(0)))
        level = F.flatten(F.transform(level, inside))
    return F.coalesce(*found)


def best_rendition(node: Column) -> Column:
    """struct(kind, url, width) of a JSON media node: the widest video, else the widest image, the first of equals; clips are reels."""
    version = "array<struct<url:string,width:int>>"
    images = F.from_json(F.get_json_object(node, "$.image_versions2.candidates"), version)
    videos = F.from_json(F.get_json_object(node, "$.video_versions"), version)
    width = lambda x: F.coalesce(x["width"], F.lit(0))
    best = lambda xs: F.aggregate(F.filter(xs, lambda x: x["url"].isNotNull()), F.lit(None).cast("struct<url:string,width:int>"), lambda b, x: F.when(b.isNull() | (width(x) > width(b)), x).otherwise(b))
    is_video = (F.coalesce(F.get_json_object(node, "$.media_type"), F.lit("")) == "2") | (F.size(F.coalesce(videos, F.array().cast(version))) > 0)
    kind = F.when(is_video, F.when(F.get_json_object(node, "$.product_type") == "clips", "reel").otherwise("video")).otherwise("image")
    item = F.when(is_video, best(videos)).otherwise(F.coalesce(best(images), F.struct(F.get_json_object(node, "$.display_url").alias("url"), F.lit(None).cast("int").alias("width"))))
    return F.struct(kind.alias("kind"), item["url"].alias("url"), F.nullif(item["width"], F.lit(0)).alias("width"))


def subtitle_tracks(manual: Column, automatic: Column, language: Column) -> Column:
    """Tracks to ask for: manual ones by name, of automatic ones only the original language."""
    plain = F.array_sort(F.filter(manual, lambda x: x != "live_chat"))
    originals = F.array_sort(F.filter(automatic, lambda x: F.endswith(x, F.lit("-orig"))))
    own = F.when(F.array_contains(automatic, language) & ~F.array_contains(plain, language), F.array(language)).otherwise(F.array().cast("array<string>"))
    return F.concat(plain, F.when(F.size(originals) > 0, originals).otherwise(F.coalesce(own, F.array().cast("array<string>"))))


# ---- headers --------------------------------------------------------------------


def clean_headers(headers: Column) -> Column:
    """Headers (name, value) with line breaks joined by commas; what isn't a header's name goes to the value before it."""
    start = F.array().cast("array<struct<name:string,value:string>>")

    def add(out: Column, h: Column) -> Column:
        name = F.trim(F.coalesce(h["name"], F.lit("")))
        value = F.regexp_replace(F.coalesce(h["value"], F.lit("")), "\r\n|\r|\n", ", ")
        last = F.get(out, F.size(out) - 1)
        folded = F.struct(last["name"].alias("name"), F.concat(last["value"], F.lit(", "), name, F.lit(": "), value).alias("value"))
        fits = name.rlike(r"^[!#$%&'*+\-.^_`|~0-9A-Za-z]+$")
        skip = (name == "") | F.startswith(name, F.lit(":")) | name.rlike("[\r\n]")
        more = F.when(F.size(out) > 0, F.concat(F.slice(out, 1, F.greatest(F.size(out) - 1, F.lit(0))), F.array(folded))).otherwise(out)
        return F.when(skip, out).when(fits, F.concat(out, F.array(F.struct(name.alias("name"), value.alias("value"))))).otherwise(more)

    return F.aggregate(headers, start, add)


# ---- metadata ---------------------------------------------------------------------

#: Names of metadata elements in their standard order; all but the last are Dublin Core. Fixed values.
ELEMENTS = ("Title", "Creator", "Subject", "Description", "Publisher", "Contributor", "Date", "Type", "Format", "Identifier", "Source", "Language", "Relation", "Coverage", "Rights", "Collector")
#: Longest names and values, and most fields. Fixed values.
NAME_CHARS, VALUE_CHARS, MOST_FIELDS = 100, 5000, 500


def _one_line(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"(?U)\s+", " "))


def canonical_name(name: Column) -> Column:
    """A standard element's own spelling, whatever the case; other names with white space collapsed."""
    plain = _one_line(name)
    known = F.create_map(*[F.lit(x) for e in ELEMENTS for x in (e.lower(), e)])
    return F.coalesce(F.try_element_at(known, F.lower(plain)), plain)


def metadata_fields(fields: Column) -> Column:
    """struct(fields, problem): fields (name, value) cleaned, without blank ones; problem says which limit is broken."""
    clean = F.transform(fields, lambda f: F.struct(canonical_name(f["name"]).alias("name"), _one_line(f["value"]).alias("value")))
    kept = F.filter(clean, lambda f: (F.coalesce(f["name"], F.lit("")) != "") & (F.coalesce(f["value"], F.lit("")) != ""))
    long = lambda c, n: F.exists(kept, lambda f: F.length(f[c]) > n)
    problem = F.when(long("name", NAME_CHARS), "name too long").when(long("value", VALUE_CHARS), "value too long").when(F.size(kept) > MOST_FIELDS, "too many fields")
    return F.struct(kept.alias("fields"), problem.alias("problem"))


def standard_order(fields: Column) -> Column:
    """Fields by their element's place in the standard, others after them by first appearance; equal names keep their order."""
    names = F.transform(fields, lambda f: f["name"])
    place = F.array(*[F.lit(e) for e in ELEMENTS])
    rank = lambda n: F.coalesce(F.nullif(F.array_position(place, n), F.lit(0).cast("long")), F.lit(len(ELEMENTS) + 1).cast("long"))
    keyed = F.transform(fields, lambda f, i: F.struct(rank(f["name"]).alias("r"), F.array_position(names, f["name"]).alias("p"), i.alias("i"), f["name"].alias("name"), f["value"].alias("value")))
    return F.transform(F.array_sort(keyed), lambda x: F.struct(x["name"].alias("name"), x["value"].alias("value")))


def warc_field(name: Column) -> Column:
    """A field's name in a WARC metadata record."""
    slug = F.regexp_replace(F.regexp_replace(F.lower(name), r"[^\p{L}\p{N}_-]", "-"), "^-+|-+$", "")
    return F.when(name.isin(*ELEMENTS[:-1]), F.concat(F.lit("dc."), F.lower(name))).when(name == ELEMENTS[-1], F.lower(name)).otherwise(F.concat(F.lit("custom."), F.coalesce(F.nullif(slug, F.lit("")), F.lit("field"))))


def warc_fields(fields: Column) -> Column:
    """The body of a WARC metadata record."""
    return F.concat(F.array_join(F.transform(fields, lambda f: F.concat(warc_field(f["name"]), F.lit(": "), f["value"])), "\r\n"), F.lit("\r\n"))


# ---- choices ------------------------------------------------------------------------


#: First words of answers that mean to keep or to reject. Fixed values.
KEEP = ("yes", "relevant", "keep", "true")
REJECT = ("no", "irrelevant", "not", "reject", "false")


def yes_or_no(answer: Column) -> Column:
    """keep, reject or unsure by the first word of a model's answer."""
    word = F.regexp_extract(F.lower(answer), "([a-z]+)", 1)
    return F.when(word.isin(*KEEP), "keep").when(word.isin(*REJECT), "reject").otherwise("unsure")


def uploaded_at(timestamp: Column, released: Column, day: Column, release_day: Column) -> Column:
    """A video's time: of upload or release in seconds, else the day at midnight."""
    stamp = F.coalesce(F.nullif(timestamp, F.lit(0).cast("long")), released)
    text = F.coalesce(F.nullif(day, F.lit("")), release_day)
    by_day = F.when(text.rlike("^[0-9]{8}$"), F.concat(F.substring(text, 1, 4), F.lit("-"), F.substring(text, 5, 2), F.lit("-"), F.substring(text, 7, 2), F.lit("T00:00:00Z")))
    return F.when(stamp > 0, F.date_format(F.timestamp_seconds(stamp), "yyyy-MM-dd'T'HH:mm:ss'Z'")).otherwise(by_day)


def is_reply(reply_to: Column, conversation: Column, post: Column, root: Column, root_conversation: Column) -> Column:
    """Whether a post belongs to another's replies: a direct one, or a later one of the conversation that the other began."""
    later = (root_conversation == root) & (conversation == root) & (post > root)
    return F.coalesce((reply_to == root) | later, F.lit(False))


def listing_refusal(operation: Column, operations: tuple[str, ...], listed_user: Column, user: Column, author: Column, handle: Column, author_handle: Column) -> Column:
    """Why a post doesn't count as the listing's own; ids decide where there are some, handles otherwise."""
    by_id = F.when((listed_user != "") & (listed_user != user), "listing_of_another_user").when((author != "") & (author != user), "another_author")
    by_name = F.when((handle != "") & (F.lower(author_handle) != F.lower(handle)), "another_author")
    return F.coalesce(F.when(~F.coalesce(operation.isin(*operations), F.lit(False)), "not_from_the_listing_operation"), F.when(F.coalesce(user, F.lit("")) != "", by_id).otherwise(by_name))


def requested(post: Column, permalink: Column, wanted: Column) -> Column:
    """Whether a post is the single one that was asked for; without one all are."""
    return wanted.isNull() | (post == wanted) | F.coalesce(F.contains(permalink, wanted), F.lit(False))


#: Letters of British postcodes: of an area's first and second place, after the only digit of a one-letter area, and of the inward part. Fixed values.
AREA, SECOND, AFTER_DIGIT, INWARD = "A-PR-UWYZ", "A-HK-Y", "A-HJKS-UW", "ABD-HJLNP-UW-Z"


def postcode_pattern() -> str:
    """A postcode: area, district (one or two digits, or a digit and a letter), inward part of a digit and two letters; and one of its own kind."""
    one_letter = f"[{AREA}][0-9](?:[0-9]|[{AFTER_DIGIT}])?"
    two_letters = f"[{AREA}][{SECOND}][0-9][0-9A-Z]?"
    return f"(?:{two_letters}|{one_letter}) *[0-9][{INWARD}]{{2}}|GIR0AA"


def is_postcode(text: Column) -> Column:
    return text.rlike(f"(?i)^(?:{postcode_pattern()})$")


def xml_root(text: Column) -> Column:
    """namespace#name of an XML document's root element in lower case; null without a namespace."""
    quoted = r"""(?:"[^"]*+"|'[^']*+')"""
    subset = rf"""\[(?:<!--.*?-->|{quoted}|[^\]"'<]++|<)*+\]"""
    root = rf"""(?s)^\s*(?:<\?.*?\?>|<!--.*?-->|<!(?:{subset}|{quoted}|[^>\["']++)*+>|\s)*<((?:[\w.-]+:)?)([\w.-]+)([^>]*)>"""
    prefix, name, attrs = (F.regexp_extract(text, root, k) for k in (1, 2, 3))
    own = F.when(prefix == "", F.lit("xmlns")).otherwise(F.concat(F.lit("xmlns:"), F.regexp_replace(prefix, ":$", "")))
    space = F.get(F.filter(F.transform(F.regexp_extract_all(attrs, F.lit(r"""([\w:.-]+\s*=\s*(?:"[^"]*"|'[^']*'))"""), 1), lambda a: F.struct(F.trim(F.split_part(a, F.lit("="), F.lit(1))).alias("k"), F.regexp_extract(a, r"""=\s*["'](.*)["']$""", 1).alias("v"))), lambda x: x["k"] == own), F.lit(0))["v"]
    return F.when(F.trim(space) != "", F.concat(F.lower(space), F.lit("#"), F.lower(name)))


def fuzzy_text(blocks: Column, name: Column) -> Column:
    """size:hash:hash:name of exactly two blocks (size, hash), the smaller size first; null otherwise."""
    own = F.array_sort(blocks)
    return F.when(F.size(own) == 2, F.concat_ws(":", own[0]["size"].cast("string"), own[0]["hash"], own[1]["hash"], name))


def shown_title(text: Column, most: int = 120) -> Column:
    """A title of at most so many characters, with an ellipsis if it was cut."""
    return F.when(F.length(text) > most, F.concat(F.rtrim(F.left(text, F.lit(most - 1))), F.lit("…"))).otherwise(text)
