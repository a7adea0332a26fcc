"""From platform records to search documents, and choices among a record's parts."""

from __future__ import annotations

from collections.abc import Callable, Mapping

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cairn.functions import urls as U

#: A mapper gives (id, type, url, title, text, author, published) from a platform's records.
FIELDS = ("id", "type", "url", "title", "text", "author", "published")
Mapper = Callable[[DataFrame], DataFrame]
MAPPERS: dict[str, Mapper] = {}


def mapper(name: str) -> Callable[[Mapper], Mapper]:
    def keep(f: Mapper) -> Mapper:
        MAPPERS[name] = f
        return f

    return keep


def _fields(rows: DataFrame, **cols: Column) -> DataFrame:
    return rows.select(*[(cols[f] if f in cols else F.lit(None)).cast("string").alias(f) for f in FIELDS])


@mapper("post")
def posts(rows: DataFrame) -> DataFrame:
    return _fields(rows, id=F.concat(F.lit("post:"), F.col("post_id").cast("string")), type=F.lit("post"), url=F.col("url"), text=F.col("text"), author=F.col("author"), published=F.col("created"))


@mapper("comment")
def comments(rows: DataFrame) -> DataFrame:
    return _fields(rows, id=F.concat(F.lit("comment:"), F.col("comment_id").cast("string")), type=F.when(F.col("parent_id").isNull(), "comment").otherwise("reply"), url=F.col("url"), text=F.col("text"), author=F.col("author"), published=F.col("created"))


@mapper("profile")
def profiles(rows: DataFrame) -> DataFrame:
    return _fields(rows, id=F.concat(F.lit("profile:"), F.col("user_id").cast("string")), type=F.lit("profile"), url=F.col("url"), title=F.col("name"), text=F.col("description"))


@mapper("video")
def videos(rows: DataFrame) -> DataFrame:
    return _fields(rows, id=F.concat(F.lit("video:"), F.col("video_id").cast("string")), type=F.lit("video"), url=F.col("url"), title=F.col("title"), text=F.col("description"), author=F.col("author"), published=F.col("created"))


def documents(tables: Mapping[str, DataFrame]) -> DataFrame:
    """All records of a capture as documents, by the mapper of each table's kind."""
    parts = [MAPPERS[kind](rows) for kind, rows in tables.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def header(headers: Column, name: str, longest: int = 2048) -> Column:
    """The first header of a name, cut."""
    return F.substring(F.get(F.filter(headers, lambda h: F.lower(h["name"]) == name.lower()), F.lit(0))["value"], 1, longest)


def enriched(rows: DataFrame, send: Mapping[str, str], take: Mapping[str, str], service: Callable[[list[dict]], list[dict]], kind: str = "string") -> DataFrame:
    """rows with columns from an outside service, asked once for each batch; only the fields that it gives are set.

    send and take name the service's fields by column. service must be safe to
    call again, since a lost task is run again.
    """
    fresh = [c for c in take if c not in rows.columns]
    base = rows.select("*", *[F.lit(None).cast(kind).alias(c) for c in fresh])

    def run(batches):  # noqa: ANN001, ANN202
        for pdf in batches:
            asked = [dict(zip(send.values(), row, strict=True)) for row in pdf[[*send]].itertuples(index=False, name=None)]
            answers = service(asked)
            for c, name in take.items():
                pdf[c] = [a[name] if a.get(name) is not None else old for a, old in zip(answers, pdf[c], strict=True)]
            yield pd.DataFrame(pdf)

    return base.mapInPandas(run, base.schema)


class Analysers:
    """A registry of analysers: each has a test of the type and gives columns; those that don't apply give null."""

    def __init__(self) -> None:
        self.known: dict[str, tuple[Column, Column]] = {}

    def register(self, name: str, applies: Column, result: Column) -> None:
        self.known[name] = (applies, result)

    def run(self, rows: DataFrame, *enabled: str) -> DataFrame:
        return rows.withColumns({n: F.when(a, r) for n, (a, r) in self.known.items() if not enabled or n in enabled})


def robots_allowed(pages: DataFrame, rules: DataFrame) -> DataFrame:
    """pages (url) with allowed, by rules (origin, allow, prefix): the longest prefix decides, allow wins ties, no rule allows."""
    origin = F.concat(U.scheme(F.col("url")), F.lit("://"), U.hostport(F.col("url")))
    byo = rules.groupBy("origin").agg(F.collect_list(F.struct(F.length("prefix").alias("n"), "allow", "prefix")).alias("_rules"))
    joined = pages.withColumn("origin", origin).join(byo, "origin", "left")
    hit = F.array_max(F.filter(F.coalesce("_rules", F.array().cast("array<struct<n:int,allow:boolean,prefix:string>>")), lambda r: F.startswith(U.path(F.col("url")), r["prefix"])))
    return joined.withColumn("allowed", F.coalesce(hit["allow"], F.lit(True))).drop("_rules", "origin")


def under_host(name: Column, listed: tuple[str, ...]) -> Column:
    """Whether a host is one of those listed or below one."""
    out = F.lit(False)
    for h in listed:
        out = out | (name == h) | F.endswith(name, F.lit(f".{h}"))
    return out


def promoted(kind: Column, entry: Column) -> Column:
    return F.coalesce(kind == "promoted", F.lit(False)) | F.coalesce(entry.rlike("^(promoted|who-to-follow|cursor)"), F.lit(False))


def best_media(items: Column, kind: str = "video/mp4") -> Column:
    """The item of a type with the highest bitrate, the first of equals."""
    fit = F.filter(items, lambda x: x["type"] == kind)
    return F.aggregate(fit, F.get(fit, F.lit(0)), lambda best, x: F.when(x["bitrate"] > best["bitrate"], x).otherwise(best))


def thread_bucket(path: Column) -> Column:
    """A comment's place without its own position in its list."""
    return F.regexp_extract(path, r"^(.*)\.edges\.[0-9]+[^.]*$", 1)


def first_match(keys: list[tuple[Column, Column]], wanted: Column) -> Column:
    """The value of the first key that equals what is wanted."""
    return F.coalesce(*[F.when(k == wanted, v) for k, v in keys])


def redacted(text: Column, patterns: Mapping[str, str], mark: str = "[removed]") -> Column:
    """struct(text, changed): every pattern's matches replaced, and the names of the patterns that matched."""
    out = text
    for p in patterns.values():
        out = F.regexp_replace(out, p, mark)
    changed = F.array_compact(F.array(*[F.when(text.rlike(p), F.lit(n)) for n, p in patterns.items()]))
    return F.struct(out.alias("text"), changed.alias("changed"))


def held_back(exchanges: DataFrame, pages: DataFrame, page: str) -> DataFrame:
    """Exchanges of accepted pages; the others are discarded with their page."""
    return exchanges.join(pages.where("accepted").select(page).distinct(), page, "left_semi")


def deep_merged(base: dict, over: dict) -> dict:
    """over on top of base, dictionary by dictionary."""
    out = dict(base)
    for k, v in over.items():
        out[k] = deep_merged(out[k], v) if isinstance(v, dict) and isinstance(out.get(k), dict) else v
    return out


def seed_rows(config: dict) -> list[dict]:
    """A crawl configuration's seeds, each on top of the defaults; an error without any."""
    seeds = [s if isinstance(s, dict) else {"url": s} for s in config.get("seeds") or []]
    if not seeds:
        raise ValueError("a configuration needs seeds")
    return [deep_merged(config.get("defaults") or {}, s) for s in seeds]


def rewritten(value: Column, rules: list[tuple[str, str]]) -> Column:
    """The value by the first rule whose pattern it is as a whole, or null."""
    return F.coalesce(*[F.when(value.rlike(f"^(?:{p})$"), F.regexp_replace(value, p, by)) for p, by in rules])


def fallback(first: DataFrame, second: DataFrame, key: str) -> DataFrame:
    """Rows of the first source, and those of the second for keys that the first lacks; served says which."""
    rest = second.join(first.select(key).distinct(), key, "left_anti")
    return first.withColumn("served", F.lit("first")).unionByName(rest.withColumn("served", F.lit("second")))


def observed(rows: DataFrame, keys: list[str], order: str, score: list[str], flag: str) -> DataFrame:
    """One row of each key from many observations: the fullest, its flag or-ed, and how often it was seen."""
    rest = [c for c in rows.columns if c not in (*keys, flag)]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*score, (-F.col(order)).alias("_o"))).alias("b"), F.bool_or(flag).alias(flag), F.count("*").alias("seen_times")).select(*keys, "b.*", flag, "seen_times")
