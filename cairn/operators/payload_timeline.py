"""Timelines that payloads build up by instructions: entries are added, pinned, replaced or put into modules, and an end is declared.

A payload becomes rows of one operation on one item each, in their order. All
that follows is aggregates over those rows: the entries of a timeline are the
last operation on each, a post is the fullest of its representations, and cursors
are the last of each kind. Nothing is folded in one task, so a timeline may have
any number of payloads and entries.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cairn.operators.social_json import BUDGET, walk

#: Types of instructions, and what they do. Fixed values.
OPERATIONS = {"TimelineAddEntries": "add", "TimelinePinEntry": "pin", "TimelineReplaceEntry": "replace", "TimelineAddToModule": "extend", "TimelineTerminateTimeline": "terminate"}
#: Beginnings of the ids of entries that the service puts between the posts. Fixed values.
INJECTED = ("who-to-follow-", "module-", "messageprompt-", "cursor-", "toptabsrpusermodule-", "tweetdetailrelatedtweets-", "trends-", "list-to-follow-")
#: Types of items, of cursors, and of results without a post. Fixed values.
POST_ITEM, CURSOR_ITEM = "TimelineTweet", "TimelineTimelineCursor"
ABSENT = {"TweetTombstone": "tombstone", "TweetUnavailable": "unavailable"}

ROW = "path string, op string, entry_id string, member_id string, item string, direction string, cut boolean, seq int"
#: Rows that leave a payload at a time.
ROWS = 2000


def _dicts(value: object) -> list[dict]:
    return [x for x in value if isinstance(x, dict)] if isinstance(value, list) else []


def _items(entry: dict) -> Iterator[tuple[str | None, dict]]:
    """(id within a module, item) of an entry: a cursor's own content counts as an item."""
    content = next((entry[k] for k in ("content", "item") if isinstance(entry.get(k), dict)), {})
    if content.get("cursorType") or content.get("entryType") == CURSOR_ITEM:
        yield None, {"itemType": CURSOR_ITEM} | content
    if isinstance(content.get("itemContent"), dict):
        yield None, content["itemContent"]
    for member in _dicts(content.get("items")):
        inner = member.get("item")
        if isinstance(inner, dict) and isinstance(inner.get("itemContent"), dict):
            yield str(member.get("entryId") or ""), inner["itemContent"]


def operations_of(payload: str | None, budget: int = BUDGET) -> Iterator[tuple]:
    """Rows of ROW for each instruction list of a payload, wherever it stands; a list that holds anything but typed objects is none."""
    seq, inside = 0, None
    for path, _, node, cut in walk(payload, budget):
        listed = node.get("instructions")
        if inside is not None and path.startswith(inside):
            continue
        if not isinstance(listed, list) or not all(isinstance(x, dict) and "type" in x for x in listed):
            if cut:
                yield path, "cut", None, None, None, None, True, seq
            continue
        where = inside = f"{path}.instructions" if path else "instructions"
        for instruction in listed:
            op = OPERATIONS.get(str(instruction["type"]))
            if op is None:
                continue
            if op == "terminate":
                yield where, op, None, None, None, str(instruction.get("direction") or ""), cut, seq
                seq += 1
                continue
            module = {"entryId": instruction.get("moduleEntryId") or "module", "content": {"items": instruction.get("moduleItems")}}
            for entry in [*_dicts(instruction.get("entries")), *_dicts([instruction.get("entry")]), *([module] if op == "extend" else [])]:
                for member, item in _items(entry):
                    yield where, op, str(entry.get("entryId") or ""), member, json.dumps(item, ensure_ascii=False), None, cut, seq
                    seq += 1


def operations(payloads: DataFrame, column: str, order: str, budget: int = BUDGET) -> DataFrame:
    """payloads without column, a row for each operation on an item; at is its place: order of the payload, then within it.

    kind says what the item is: post, absence, cursor, promoted, injected, or
    end for the end of a timeline; cut marks a payload of more than budget nodes.
    """
    kept = [f for f in payloads.schema.fields if f.name != column]
    names = [f.name for f in kept]
    schema = T.StructType(kept + T.StructType.fromDDL(ROW).fields)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in batches:
            out: list[tuple] = []
            for own, payload in zip(frame[names].itertuples(index=False, name=None), frame[column], strict=True):
                for row in operations_of(payload, budget):
                    out.append((*own, *row))
                    if len(out) >= ROWS:
                        yield pd.DataFrame(out, columns=schema.names)
                        out = []
            yield pd.DataFrame(out, columns=schema.names)

    rows = payloads.mapInPandas(run, schema)
    get = lambda path: F.nullif(F.get_json_object("item", path), F.lit(""))
    item_type, result = F.coalesce(get("$.itemType"), F.lit(POST_ITEM)), get("$.tweet_results.result.__typename")
    between = F.lower("entry_id").rlike(f"^(?:{'|'.join(INJECTED)})")
    kind = (
        F.when(F.col("op").isin("terminate", "cut"), F.when(F.col("op") == "cut", "cut").otherwise("end"))
        .when((item_type == CURSOR_ITEM) & get("$.value").isNotNull(), "cursor")
        .when(between | (item_type != POST_ITEM), "injected")
        .when(get("$.promotedMetadata").isNotNull(), "promoted")
        .when(result.isin(*ABSENT), "absence")
        .otherwise("post")
    )
    return rows.withColumn("kind", kind).withColumn("at", F.struct(F.col(order).alias("payload"), "seq")).drop("seq")


def entries(ops: DataFrame, timeline: str) -> DataFrame:
    """What stands in a timeline: for each entry, or member of a module, the item of the last operation on it, and whether it was pinned."""
    own = ops.where(F.col("kind").isin("post", "absence"))
    last = own.groupBy(timeline, "entry_id", "member_id").agg(F.max_by(F.struct("op", "kind", "item"), "at").alias("l"), F.bool_or(F.col("op") == "pin").alias("pinned"), F.min("at").alias("first_at"))
    return last.select(timeline, "entry_id", "member_id", "pinned", "first_at", "l.*")


def posts(ops: DataFrame, timeline: str) -> DataFrame:
    """The posts of a timeline, each in its fullest representation (the first of equals), pinned if any of them was."""
    raw = F.coalesce(F.get_json_object("item", "$.tweet_results.result.tweet"), F.get_json_object("item", "$.tweet_results.result"))
    own = ops.where("kind = 'post'").withColumn("raw", raw)
    get = lambda *paths: F.coalesce(*[F.nullif(F.get_json_object("raw", p), F.lit("")) for p in paths])
    user = "$.core.user_results.result"
    own = own.withColumns({
        "post_id": get("$.rest_id", "$.legacy.id_str"), "text": get("$.note_tweet.note_tweet_results.result.text", "$.legacy.full_text", "$.legacy.text"), "author_id": get(f"{user}.rest_id"), "author_handle": get(f"{user}.core.screen_name", f"{user}.legacy.screen_name"),
        "created": get("$.legacy.created_at"), "conversation_id": get("$.legacy.conversation_id_str"), "reply_count": get("$.legacy.reply_count").try_cast("long"), "like_count": get("$.legacy.favorite_count").try_cast("long"),
        "media": F.coalesce(F.json_array_length(get("$.legacy.extended_entities.media", "$.legacy.entities.media")), F.lit(0)), "module": F.when(F.col("member_id").isNotNull(), F.col("entry_id")), "entry": F.coalesce("member_id", "entry_id"),
    }).where("post_id IS NOT NULL")
    shown = ["text", "author_id", "author_handle", "created", "conversation_id", "reply_count", "like_count", "media", "op", "path", "module", "entry"]
    full = F.struct("media", F.col("text").isNotNull().alias("t"), F.col("author_id").isNotNull().alias("a"), F.col("reply_count").isNotNull().alias("r"), F.length("raw").alias("n"))
    most = own.groupBy(timeline, "post_id").agg(F.max(full).alias("f"), F.bool_or(F.col("op") == "pin").alias("pinned"), F.min("at").alias("first_at"))
    fullest = own.withColumn("f", full).join(most, [timeline, "post_id", "f"]).groupBy(timeline, "post_id", "pinned", "first_at").agg(F.min_by(F.struct(*shown), "at").alias("p"))
    return fullest.select(timeline, "post_id", "pinned", "first_at", "p.*")


def absences(ops: DataFrame, timeline: str) -> DataFrame:
    """Places where a post isn't shown: what stands there instead, the reason given, and the post's id as the entry names it."""
    get = lambda *paths: F.coalesce(*[F.nullif(F.get_json_object("item", p), F.lit("")) for p in paths])
    named = F.create_map(*[F.lit(x) for pair in ABSENT.items() for x in pair])
    entry = F.coalesce("member_id", "entry_id")
    return ops.where("kind = 'absence'").select(timeline, entry.alias("entry"), F.nullif(F.regexp_extract(entry, "([0-9]+)$", 1), F.lit("")).alias("post_id"), named[get("$.tweet_results.result.__typename")].alias("what"), get("$.tweet_results.result.tombstone.text.text", "$.tweet_results.result.reason").alias("reason"))


def cursors(ops: DataFrame, timeline: str) -> DataFrame:
    """The last cursor of each kind, by which a timeline is asked for more, and whether it ends at an empty answer."""
    get = lambda path: F.get_json_object("item", path)
    own = ops.where("kind = 'cursor'").select(timeline, F.coalesce(F.nullif(get("$.cursorType"), F.lit("")), F.when(F.col("member_id").isNotNull(), "ShowMore").otherwise("Bottom")).alias("cursor"), get("$.value").alias("value"), get("$.stopOnEmptyResponse").try_cast("boolean").alias("stop_on_empty"), "at")
    return own.groupBy(timeline, "cursor").agg(F.max_by(F.struct("value", "stop_on_empty"), "at").alias("c")).select(timeline, "cursor", "c.*")


def summary(ops: DataFrame, timeline: str) -> DataFrame:
    """What was read of a timeline: rows of each kind, the directions in which it ended, whether a payload was cut."""
    n = lambda kind: F.count_if(F.col("kind") == kind)
    return ops.groupBy(timeline).agg(
        *[n(k).alias(k if k in ("injected", "promoted") else f"{k}s") for k in ("post", "absence", "cursor", "injected", "promoted")],
        F.array_sort(F.collect_set(F.when(F.col("kind") == "end", F.col("direction")))).alias("ended"), F.bool_or("cut").alias("cut"),
    )


def pages_left(ops: DataFrame, timeline: str, direction: str = "Bottom") -> DataFrame:
    """Timelines that didn't end in a direction, with the cursor that asks for more."""
    ended = ops.where((F.col("kind") == "end") & (F.col("direction") == direction)).select(timeline).distinct()
    return cursors(ops, timeline).where(F.col("cursor") == direction).join(ended, timeline, "left_anti")

