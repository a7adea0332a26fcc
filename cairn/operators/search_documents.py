"""Search documents of platform records: one description for each kind of record, one builder for all."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cairn.functions import texts as X
from cairn.functions import times as S
from cairn.functions import urls as U


@dataclass(frozen=True)
class Kind:
    """Where a document's parts are in a record. Names of columns; of several the first that is there counts, unless said otherwise."""

    platform: str
    kind: str
    type: str
    id: tuple[str, ...]
    #: Columns with an address, and the address to make from the id (or another column) without one.
    url: tuple[str, ...] = ()
    made_url: str = ""
    made_from: str = ""
    #: All of these, joined.
    text: tuple[str, ...] = ()
    title: tuple[str, ...] = ()
    authors: tuple[str, ...] = ()
    #: Authors that are handles, shown with an @.
    handles: tuple[str, ...] = ()
    published: str = ""
    description: str = ""
    #: Columns of lists, or of single values.
    keywords: tuple[str, ...] = ()
    links: tuple[str, ...] = ()
    images: tuple[str, ...] = ()
    language: str = ""
    #: More addresses under which the record may have been saved: columns, and addresses made from the id or made_from.
    evidence: tuple[str, ...] = ()
    also: tuple[str, ...] = ()
    #: A column whose value ends the category, and what stands for a missing one.
    category_of: str = ""
    category: str = ""
    extra: tuple[str, ...] = field(default=())


#: Names of fields and types as platform records and the index have them. Fixed values.
KINDS = (
    Kind("facebook", "post", "Facebook Post", ("post_id",), ("permalink_url", "page_url"), text=("text",), authors=("author_name",), published="created_time", images=("media_urls",), category="post",
         extra=("author_id", "reactions_count", "comments_count", "shares_count", "is_pinned", "source", "page_url")),
    Kind("facebook", "comment", "Facebook Comment", ("comment_id",), made_url="{from}?comment_id={id}", made_from="parent_permalink", text=("text",), authors=("author_name",), published="created_time", images=("media_urls",), category="comment",
         extra=("parent_post_id", "parent_comment_id", "author_id", "depth")),
    Kind("facebook", "photo", "Facebook Photo", ("photo_id",), ("photo_url",), evidence=("post_url",), text=("caption",), authors=("owner_name",), published="created_time", images=("image_url",), category="photo",
         extra=("post_id", "album_id", "width", "height", "belongs_to_captured_post")),
    Kind("instagram", "post", "Instagram Post", ("media_id", "shortcode"), ("permalink_url",), "https://www.instagram.com/p/{from}/", "shortcode", text=("caption",), authors=("owner_username",), published="created_time", images=("media_urls",), category_of="kind", category="post",
         extra=("shortcode", "owner_id", "kind", "likes_count", "comments_count", "video_view_count", "is_pinned", "surface", "source")),
    Kind("instagram", "comment", "Instagram Comment", ("comment_id",), made_url="{from}c/{id}/", made_from="parent_permalink", evidence=("parent_permalink",), text=("text",), authors=("author_username",), published="created_time", category="comment",
         extra=("post_shortcode", "parent_comment_id", "author_id", "likes_count", "depth")),
    Kind("instagram", "profile", "Instagram Profile", ("user_id", "username"), made_url="https://www.instagram.com/{from}/", made_from="username", text=("biography",), title=("full_name", "username"), authors=("username",), description="biography", links=("external_url",), images=("profile_pic_url",), category="profile",
         extra=("username", "followers_count", "following_count", "posts_count", "is_private", "is_verified")),
    Kind("x", "post", "X Post", ("post_id",), ("permalink_url",), "https://x.com/i/status/{id}", also=("https://twitter.com/i/status/{id}",), text=("text",), handles=("author_handle",), authors=("author_name",), published="created_time", keywords=("hashtags",), language="lang", links=("urls",), images=("media_urls",), category_of="capture_role", category="post",
         extra=("author_id", "relationship", "capture_role", "conversation_id", "in_reply_to_post_id", "in_reply_to_handle", "original_post_id", "quoted_post_id", "reply_count", "repost_count", "like_count", "quote_count", "view_count", "is_pinned", "mentions")),
    Kind("x", "user", "X User", ("user_id",), made_url="https://x.com/{from}", made_from="handle", also=("https://twitter.com/{from}",), text=("description",), title=("name", "handle"), handles=("handle",), authors=("name",), published="created_time", description="description", links=("url",), images=("profile_image_url",), category="user",
         extra=("handle", "location", "followers_count", "following_count", "posts_count", "is_protected", "is_verified")),
    Kind("youtube", "video", "YouTube Video", ("video_id",), ("url",), "https://www.youtube.com/watch?v={id}", text=("title", "description"), title=("title",), authors=("channel_name", "channel_handle"), published="published_time", description="description", keywords=("tags", "categories"), images=("thumbnail_url",), category_of="kind", category="video",
         extra=("channel_id", "duration_seconds", "live_status", "availability", "view_count", "like_count", "comment_count", "media_file", "complete", "source")),
    Kind("youtube", "post", "YouTube Post", ("post_id",), ("url",), "https://www.youtube.com/post/{id}", text=("text",), authors=("author_name", "channel_handle"), published="published_time", images=("images",), category_of="kind", category="text",
         extra=("channel_id", "kind", "like_count", "comment_count", "attached_video_id", "shared_post_id", "published_text", "source")),
    Kind("youtube", "comment", "YouTube Comment", ("comment_id",), made_url="{from}&lc={id}", made_from="target_url", text=("text",), authors=("author_name",), published="published_time", category="comment",
         extra=("target_type", "target_id", "parent_id", "thread_root_id", "reply_depth", "author_channel_id", "author_is_uploader", "like_count", "is_pinned", "published_text")),
    Kind("youtube", "channel", "YouTube Channel", ("channel_id",), ("url",), "https://www.youtube.com/{from}", "handle", text=("description",), title=("name", "handle"), authors=("name", "handle"), description="description", links=("external_links",), images=("avatar_url", "banner_url"), category="channel",
         extra=("handle", "subscriber_count", "video_count", "source")),
    Kind("youtube", "playlist", "YouTube Playlist", ("playlist_id",), ("url",), "https://www.youtube.com/playlist?list={id}", text=("title", "description"), title=("title",), authors=("channel_name",), description="description", category="playlist",
         extra=("channel_id", "item_count")),
)
#: Fields of links and media that are objects: the first that is there is the address. Fixed values.
ADDRESSES = ("expanded_url", "url")
BY_NAME = {(k.platform, k.kind): k for k in KINDS}


def built(rows: DataFrame, kind: Kind, collection: str, captured: Column) -> DataFrame:
    """Search documents of records. Columns that the records lack count as null; a document's lists have each value once, in order."""
    have = {f.name: f for f in rows.schema.fields}

    def one(*names: str) -> Column:
        own = [F.nullif(F.col(n).cast("string"), F.lit("")) for n in names if n in have]
        return F.coalesce(*own, F.lit(None).cast("string"))

    def listed(name: str) -> Column:
        """A column's values as a list of strings: of objects their addresses."""
        kind = have[name].dataType
        if kind.typeName() != "array":
            return F.array(F.col(name).cast("string"))
        if kind.elementType.typeName() != "struct":
            return F.col(name).cast("array<string>")
        own = [f for f in ADDRESSES if f in kind.elementType.names]
        return F.transform(F.col(name), lambda x: F.coalesce(*[F.nullif(x[f].cast("string"), F.lit("")) for f in own], F.lit(None).cast("string")))

    def many(names: tuple[str, ...]) -> Column:
        parts = [listed(n) for n in names if n in have]
        parts = [F.coalesce(p, F.array().cast("array<string>")) for p in parts]
        return F.concat(*parts) if parts else F.array().cast("array<string>")

    def distinct(items: Column) -> Column:
        return F.array_distinct(F.filter(F.transform(items, X.collapsed), lambda x: F.coalesce(x, F.lit("")) != ""))

    key = one(*kind.id)
    source = one(kind.made_from) if kind.made_from else key

    def filled(template: str) -> Column:
        """An address from a template with {id} and {from}; null where one of them is."""
        return F.concat(*[{"{id}": key, "{from}": source}.get(part, F.lit(part)) for part in re.split(r"({id}|{from})", template) if part])

    made = filled(kind.made_url) if kind.made_url else F.lit(None).cast("string")
    if kind.made_url.startswith("{from}&"):  # the address may have no query yet
        made = F.when(source.isNotNull() & ~F.contains(source, F.lit("?")), F.concat(source, F.lit("?lc="), key)).otherwise(made)
    url = F.coalesce(one(*kind.url), made)
    saved = F.col("provenance.url") if "provenance" in have and "url" in getattr(have["provenance"].dataType, "names", ()) else F.lit(None).cast("string")
    evidence = F.array_distinct(F.array_compact(F.array(url, *[one(n) for n in kind.url], made, *map(filled, kind.also), *[one(n) for n in kind.evidence], F.nullif(saved, F.lit("")))))
    raw = F.concat_ws(" ", *[one(n) for n in kind.text])
    text = F.nullif(X.collapsed(raw), F.lit(""))
    handles = [F.concat(F.lit("@"), one(n)) for n in kind.handles]
    links, images = distinct(many(kind.links)), distinct(many(kind.images))
    when = S.parse_time(one(kind.published)) if kind.published else F.lit(None).cast("timestamp")
    value = lambda n: F.array_join(F.col(n).cast("array<string>"), ",") if have[n].dataType.typeName() == "array" else F.col(n).cast("string")
    category = one(kind.category_of) if kind.category_of else F.lit(None).cast("string")
    return rows.select(
        F.concat(F.lit(f"{kind.platform}:{kind.kind}:"), key).alias("id"), F.lit(kind.type).alias("type"), F.concat(F.lit(f"{kind.platform}/{'post-' if (kind.platform, kind.kind) == ('youtube', 'post') else ''}"), F.coalesce(category, F.lit(kind.category))).alias("category"), url.alias("url"),
        text.alias("content"), F.length(text).alias("content_text_length"), F.coalesce(one(*kind.title), F.when(text.isNotNull(), X.first_line(raw))).alias("title"),
        distinct(F.array(*handles, *[one(n) for n in kind.authors])).alias("author"), F.nullif(X.collapsed(one(kind.description)), F.lit("")).alias("description") if kind.description else F.lit(None).cast("string").alias("description"), distinct(many(kind.keywords)).alias("keywords"), (one(kind.language) if kind.language else F.lit(None).cast("string")).alias("content_language"),
        S.iso_utc(captured).alias("crawl_date"), S.wayback(captured).alias("wayback_date"), F.year(captured).alias("crawl_year"), S.iso_utc(when).alias("publication_date"), F.year(when).cast("string").alias("publication_year"),
        links.alias("links"), images.alias("links_images"), F.array_sort(distinct(F.transform(F.concat(links, images), U.host))).alias("links_hosts"), F.array(F.lit(collection)).alias("collection"),
        F.array_compact(F.array(X.kv("platform", F.lit(kind.platform)), X.kv("kind", F.lit(kind.kind)), *[X.kv(n, value(n)) for n in kind.extra if n in have])).alias("content_metadata_ss"),
        F.when(text.isNotNull(), X.sha1_digest(text)).alias("hash"), U.normalised(url).alias("url_norm"), U.host(url).alias("host"), evidence.alias("evidence"),
    )


def with_parents(comments: DataFrame, posts: DataFrame, own: str, key: str, made: Column | None = None, address: str = "permalink_url") -> DataFrame:
    """comments with parent_permalink: the address of the post whose key is their column own, else made; the largest address where a key is repeated."""
    parents = posts.where(F.col(key).isNotNull()).groupBy(F.col(key).alias(own)).agg(F.max(F.nullif(F.col(address), F.lit(""))).alias("_address"))
    return comments.join(parents, own, "left").withColumn("parent_permalink", F.coalesce("_address", *([made] if made is not None else []))).drop("_address")


def located_by_evidence(docs: DataFrame, records: DataFrame) -> DataFrame:
    """docs with the record under the first of their evidence addresses that has one, and which address that is (found_by); records as for located()."""
    asked = docs.select("id", F.posexplode("evidence").alias("_rank", "found_by")).withColumn("url_norm", U.normalised(F.col("found_by")))
    record = F.struct("found_by", F.col("status").alias("status_code"), "source_file", "source_file_offset", F.col("digest").alias("record_hash"))
    best = asked.join(records, "url_norm").groupBy("id").agg(F.min_by(record, "_rank").alias("_r"))
    return docs.join(best, "id", "left").select(*docs.columns, "_r.*")


def located(docs: DataFrame, records: DataFrame) -> DataFrame:
    """docs with the record of their address: status, source_file, source_file_offset and the record's digest as hash. records: (url_norm, status, source_file, source_file_offset, digest), one for each address."""
    own = records.select("url_norm", F.col("status").alias("status_code"), "source_file", "source_file_offset", "digest")
    return docs.join(own, "url_norm", "left").withColumn("hash", F.coalesce("digest", "hash")).withColumn("record_type", F.when(F.col("source_file").isNotNull(), "response")).drop("digest")


def of_capture(tables: dict[tuple[str, str], DataFrame], collection: str, captured: Column) -> DataFrame:
    """All documents of a capture's tables by (platform, kind)."""
    parts = [built(rows, BY_NAME[name], collection, captured) for name, rows in tables.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def of_records(rows: DataFrame, institution: str, collection: str) -> DataFrame:
    """Search documents of WARC records (see sources.warc.captures): the record's own fields, with those of the envelope and of the institution."""
    url, day = F.col("target_uri"), F.regexp_replace("warc_date", "[^0-9]", "")
    kind = F.coalesce("mime", F.lit("application/octet-stream"))
    return rows.select(
        U.document_id(url, F.col("warc_date")).alias("id"), F.col("record_type"), url.alias("url"), U.normalised(url).alias("url_norm"), U.host(url).alias("host"), U.registrable(U.host(url)).alias("domain"), U.resource_name(url).alias("resourcename"),
        F.col("status").cast("string").alias("status_code"), F.col("warc_date").alias("crawl_date"), F.substring(day, 1, 14).alias("wayback_date"), F.substring(day, 1, 4).alias("crawl_year"), kind.alias("content_type_served"), F.when(F.col("record_type") != "revisit", F.col("length")).alias("content_length"),
        F.col("payload_digest").alias("hash"), F.col("warc_file").alias("source_file"), F.col("record_offset").alias("source_file_offset"), F.col("record_id").alias("warc_key_id"), F.lit(institution).alias("institution"), F.array(F.lit(collection)).alias("collection"),
    )
