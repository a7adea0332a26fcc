"""Queries of timelines that payloads build up; conversations stand for them, a turn for a post."""

from __future__ import annotations

from pyspark.sql import functions as F

from cairn.operators import payload_timeline as L
from cairn.plans.catalog import Catalog
from cairn.plans.inputs import table

query = Catalog()
QUERIES, ORACLE = query.queries, query.sql


def _operations(spark, sf):
    """Two payloads for each conversation: its turns with a cursor, then changes to them.

    Turn 2 is promoted, turn 3 withheld, turn 4 stands in a module; then turn 0
    is pinned, turn 1 replaced by a longer text, and every third conversation ends.
    """
    t, c, lit = table(spark, sf, "conversations"), F.col, F.lit
    turn = lambda k: c("turn") == k
    key = (c("conv_id") * 1000 + c("turn")).cast("string")
    # A field that is null isn't in the JSON
    legacy = lambda text: F.struct(text.alias("full_text"), c("turn").alias("reply_count"))
    result = lambda text: F.struct(F.when(turn(3), "TweetTombstone").alias("__typename"), F.when(turn(3), F.struct(F.struct(lit("withheld").alias("text")).alias("text"))).alias("tombstone"), F.when(~turn(3), key).alias("rest_id"), F.when(~turn(3), legacy(text)).alias("legacy"))
    item = lambda text: F.struct(lit("TimelineTweet").alias("itemType"), F.struct(result(text).alias("result")).alias("tweet_results"), F.when(turn(2), F.struct(lit("ad").alias("x"))).alias("promotedMetadata"))
    member = lambda text: F.struct(F.concat(lit("in-"), key).alias("entryId"), F.struct(item(text).alias("itemContent")).alias("item"))
    entry = lambda text: F.struct(F.when(turn(4), "conversation-1").otherwise(F.concat(lit("tweet-"), key)).alias("entryId"), F.struct(F.when(~turn(4), item(text)).alias("itemContent"), F.when(turn(4), F.array(member(text))).alias("items")).alias("content"))
    first = t.groupBy("conv_id").agg(F.to_json(F.array_sort(F.collect_list(F.struct("turn", entry(c("text")).alias("e"))))["e"]).alias("entries"), F.to_json(F.max(F.when(turn(0), entry(c("text"))))).alias("pin"), F.to_json(F.max(F.when(turn(1), entry(F.concat(lit("new: "), c("text")))))).alias("replace"))
    part = lambda kind, *more: F.concat(lit('{"type":"' + kind + '"'), *more, lit("}"))
    cursor = F.concat(lit('[{"entryId":"cursor-b","content":{"entryType":"TimelineTimelineCursor","cursorType":"Bottom","value":"b'), c("conv_id").cast("string"), lit('"}},{"entryId":"who-to-follow-1","content":{"itemContent":{"itemType":"TimelineUser"}}}]'))
    one = F.concat(lit('{"data":{"user":{"instructions":['), part("TimelineClearCache"), lit(","), part("TimelineAddEntries", lit(',"entries":'), c("entries")), lit(","), part("TimelineAddEntries", lit(',"entries":'), cursor), lit("]}}}"))
    pin = F.coalesce(F.concat(lit(","), part("TimelinePinEntry", lit(',"entry":'), c("pin"))), lit(""))
    replaced = F.coalesce(F.concat(lit(","), part("TimelineReplaceEntry", lit(',"entry":'), c("replace"))), lit(""))
    end = F.when(c("conv_id") % 3 == 0, F.concat(lit(","), part("TimelineTerminateTimeline", lit(',"direction":"Bottom"')))).otherwise("")
    more = part("TimelineAddToModule", lit(',"moduleEntryId":"conversation-1","moduleItems":[{"entryId":"more-1","item":{"itemContent":{"itemType":"TimelineTimelineCursor","value":"m"}}}]'))
    two = F.concat(lit('{"x":[{"instructions":['), more, pin, replaced, end, lit("]}]}"))
    payloads = first.select("conv_id", F.posexplode(F.array(one, two)).alias("nr", "payload"))
    return L.operations(payloads, "payload", "nr")


_T = "WITH t AS (SELECT *, conv_id * 1000 + turn AS k FROM conversations)"


@query("f82_timeline_operations", _T + """ SELECT conv_id, CASE WHEN turn = 4 THEN 'conversation-1' ELSE 'tweet-' || k END AS entry_id, CASE WHEN turn = 4 THEN 'in-' || k END AS member_id, CASE turn WHEN 2 THEN 'promoted' WHEN 3 THEN 'absence' ELSE 'post' END AS kind, 'add' AS op, 'data.user.instructions' AS path FROM t
UNION ALL SELECT conv_id, 'tweet-' || k, NULL, 'post', CASE turn WHEN 0 THEN 'pin' ELSE 'replace' END, 'x.0.instructions' FROM t WHERE turn < 2
UNION ALL SELECT DISTINCT conv_id, e.entry_id, e.member_id, e.kind, e.op, e.path FROM t, (VALUES ('cursor-b', NULL, 'cursor', 'add', 'data.user.instructions'), ('who-to-follow-1', NULL, 'injected', 'add', 'data.user.instructions'), ('conversation-1', 'more-1', 'cursor', 'extend', 'x.0.instructions'), (NULL, NULL, 'end', 'terminate', 'x.0.instructions')) e(entry_id, member_id, kind, op, path) WHERE kind <> 'end' OR conv_id % 3 = 0""")
def f82(spark, sf):
    return _operations(spark, sf).select("conv_id", "entry_id", "member_id", "kind", "op", "path")


@query("h34_timeline_posts", _T + """ SELECT conv_id, CAST(k AS VARCHAR) AS post_id, turn = 0 AS pinned, CASE WHEN turn = 1 THEN 'new: ' || text ELSE nullif(text, '') END AS text, CAST(turn AS BIGINT) AS reply_count, CASE WHEN turn = 1 THEN 'replace' ELSE 'add' END AS op, CASE WHEN turn = 4 THEN 'conversation-1' END AS module FROM t WHERE turn NOT IN (2, 3)""")
def h34(spark, sf):
    return L.posts(_operations(spark, sf), "conv_id").select("conv_id", "post_id", "pinned", "text", "reply_count", "op", "module")


@query("h34_timeline_state", _T + """, s AS (SELECT conv_id, count(*) FILTER (turn NOT IN (2, 3)) + count(*) FILTER (turn < 2) AS posts, count(*) FILTER (turn = 3) AS absences, count(*) FILTER (turn = 2) AS promoted, count(*) FILTER (turn <> 2) AS entries FROM t GROUP BY 1)
SELECT conv_id, posts, absences, CAST(2 AS BIGINT) AS cursors, CAST(1 AS BIGINT) AS injected, promoted, CASE WHEN conv_id % 3 = 0 THEN 'Bottom' ELSE '' END AS ended, CASE WHEN conv_id % 3 > 0 THEN 'b' || conv_id END AS more, entries, CASE WHEN absences > 0 THEN 'tombstone ' || (conv_id * 1000 + 3) || ' withheld' END AS missing FROM s""")
def h34_state(spark, sf):
    """What was read of each timeline, its entries, what is missing, and the cursor of those that go on."""
    ops = _operations(spark, sf)
    lost = L.absences(ops, "conv_id").groupBy("conv_id").agg(F.max(F.concat_ws(" ", "what", "post_id", "reason")).alias("missing"))
    held = L.entries(ops, "conv_id").groupBy("conv_id").agg(F.count("*").alias("entries"))
    left = L.pages_left(ops, "conv_id").select("conv_id", F.col("value").alias("more"))
    out = L.summary(ops, "conv_id").join(left, "conv_id", "left").join(held, "conv_id", "left").join(lost, "conv_id", "left")
    return out.select("conv_id", "posts", "absences", "cursors", "injected", "promoted", F.array_join("ended", ",").alias("ended"), "more", "entries", "missing")
