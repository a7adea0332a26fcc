"""Queries over timelines (events of users) and threads (conversations)."""

from __future__ import annotations

from pyspark.sql import functions as F

from cairn.operators import timeline as T
from cairn.plans.catalog import Catalog
from cairn.plans.inputs import table

query = Catalog()
QUERIES, ORACLE = query.queries, query.sql

#: A user's events as posts: purchases are pinned, errors are undated.
POSTS = """WITH posts AS (SELECT user_id AS target, event_id AS id, CASE WHEN event_type <> 'error' THEN epoch_us(ts) // 1000000 END AS posted, event_type = 'purchase' AS pinned,
  event_type AS kind, CAST(round(value * 100) AS BIGINT) AS weight, epoch_us(ts) // 1000000 AS seen, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events)"""
_FIRST, _LAST = 1704500000, 1705500000


def posts(spark, sf):
    e = table(spark, sf, "events")
    seen = F.unix_timestamp("ts")
    return e.select(
        F.col("user_id").alias("target"), F.col("event_id").alias("id"), F.when(F.col("event_type") != "error", seen).alias("posted"), (F.col("event_type") == "purchase").alias("pinned"),
        F.col("event_type").alias("kind"), F.round(F.col("value") * 100).cast("long").alias("weight"), seen.alias("seen"), F.get_json_object("props", "$.k").cast("long").alias("k"),
    )


@query("q23_date_range", f"{POSTS} SELECT id, coalesce(posted BETWEEN {_FIRST} AND {_LAST}, true) AS kept, coalesce(posted BETWEEN {_FIRST} AND {_LAST}, false) AS kept_dated, coalesce(posted >= {_FIRST}, false) AS newer FROM posts")
def q23(spark, sf):
    d, a, b = F.col("posted"), F.lit(_FIRST), F.lit(_LAST)
    return posts(spark, sf).select("id", T.in_range(d, a, b, True).alias("kept"), T.in_range(d, a, b, False).alias("kept_dated"), T.in_range(d, a, None, False).alias("newer"))


@query("q24_already_captured", f"{POSTS}, b AS (SELECT target, min(posted) + 86400 AS edge FROM posts GROUP BY 1) SELECT id, coalesce(posted <= edge, false) AS seen_upto, coalesce(posted < edge, false) AS seen_before FROM posts JOIN b USING (target)")
def q24(spark, sf):
    p = posts(spark, sf)
    edge = p.groupBy("target").agg((F.min("posted") + 86400).alias("edge"))
    return p.join(edge, "target").select("id", T.already_captured(F.col("posted"), F.col("edge"), True).alias("seen_upto"), T.already_captured(F.col("posted"), F.col("edge"), False).alias("seen_before"))


@query("a19_newest_per_target", f"{POSTS} SELECT target, max(struct_pack(posted := posted, id := id)).id AS id, max(posted) AS posted FROM posts WHERE NOT pinned AND posted IS NOT NULL GROUP BY 1")
def a19(spark, sf):
    return T.newest_per_target(posts(spark, sf))


@query("a20_oldest_and_newest", f"{POSTS} SELECT target, arg_min(id, (posted, id)) AS oldest, arg_max(id, (posted, id)) AS newest FROM posts WHERE posted IS NOT NULL GROUP BY 1")
def a20(spark, sf):
    return T.oldest_and_newest(posts(spark, sf))


_RUN = """{P}, h AS (SELECT *, sum(CAST({hit} AS INT)) OVER o AS hits FROM posts WINDOW o AS (PARTITION BY target ORDER BY id)),
r AS (SELECT *, hits - coalesce(max(CASE WHEN {reset} THEN hits END) OVER (PARTITION BY target ORDER BY id), 0) AS run FROM h)"""


@query("w05_consecutive_older", _RUN.format(P=POSTS, hit="coalesce(weight < 900, false)", reset="NOT pinned AND weight >= 900") + """,
s AS (SELECT *, run >= 4 AS stop, coalesce(bool_or(run >= 4) OVER (PARTITION BY target ORDER BY id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false) AS past FROM r) SELECT target, id, CAST(run AS BIGINT) AS run, stop FROM s WHERE NOT past""")
def w05(spark, sf):
    older, selected = F.col("weight") < 900, ~F.col("pinned") & (F.col("weight") >= 900)
    return T.until_run(posts(spark, sf), ["id"], older, selected, 4).select("target", "id", "run", "stop")


@query("w06_consecutive_misses", _RUN.format(P=POSTS, hit="kind <> 'click'", reset="kind = 'click'") + " SELECT target, CAST(max(run) AS BIGINT) AS longest FROM r GROUP BY 1")
def w06(spark, sf):
    click = F.col("kind") == "click"
    return T.run_lengths(posts(spark, sf), ["id"], ~click, click).groupBy("target").agg(F.max("run").alias("longest"))


@query("w07_block_backoff", _RUN.format(P=POSTS, hit="kind = 'error'", reset="kind <> 'error'") + " SELECT target, id, CAST(run AS BIGINT) AS run, pow(2.0, run) AS slower, CAST(run * 30 AS BIGINT) AS wait, CASE WHEN run = 0 THEN 'proceed' WHEN run >= 2 THEN 'stop' ELSE 'backoff' END AS action FROM r")
def w07(spark, sf):
    return T.backoff(posts(spark, sf), ["id"], F.col("kind") == "error", 2.0, 30, 2).select("target", "id", "run", "slower", "wait", "action")


@query("w08_latest_admission", f"{POSTS}, n AS (SELECT *, sum(CAST(NOT pinned AS INT)) OVER (PARTITION BY target ORDER BY id) AS n FROM posts) SELECT target, id, pinned FROM n WHERE pinned OR n <= 5")
def w08(spark, sf):
    return T.admitted(posts(spark, sf), ["id"], 5).select("target", "id", "pinned")


@query("w09_pinned_by_order", f"""{POSTS}, i AS (SELECT *, row_number() OVER (PARTITION BY target ORDER BY weight DESC, id) AS i FROM posts),
m AS (SELECT *, max(CASE WHEN i <= 6 THEN posted END) OVER (PARTITION BY target ORDER BY weight DESC, id ROWS BETWEEN 1 FOLLOWING AND 5 FOLLOWING) AS later FROM i)
SELECT target, id, coalesce(i <= 3 AND posted < later, false) AS looks_pinned FROM m""")
def w09(spark, sf):
    return T.pinned_by_order(posts(spark, sf), [F.desc("weight"), "id"]).select("target", "id", "looks_pinned")


@query("w10_comment_cap", "SELECT conv_id, least(count(*), 3) AS kept, greatest(count(*) - 3, 0) AS overflow FROM conversations GROUP BY 1")
def w10(spark, sf):
    return T.capped(table(spark, sf, "conversations"), "conv_id", ["turn"], 3)


@query("w11_reply_cap", "SELECT conv_id, turn, role FROM conversations QUALIFY row_number() OVER (PARTITION BY conv_id, role ORDER BY turn) <= 2")
def w11(spark, sf):
    return T.first_of(table(spark, sf, "conversations"), ["conv_id", "role"], ["turn"], 2).select("conv_id", "turn", "role")


@query("w15_sliding_budget", f"{POSTS} SELECT id, CAST(sum(weight) OVER (PARTITION BY target ORDER BY seen RANGE BETWEEN 3600 PRECEDING AND CURRENT ROW) AS BIGINT) AS used FROM posts")
def w15(spark, sf):
    return T.sliding_sum(posts(spark, sf), F.col("seen"), F.col("weight"), 3600, "target").select("id", "used")


@query("w16_duplicates_across_surfaces", f"{POSTS} SELECT target, k, id, kind FROM posts QUALIFY row_number() OVER (PARTITION BY target, k ORDER BY id) = 1")
def w16(spark, sf):
    return T.first_of(posts(spark, sf), ["target", "k"], ["id"]).select("target", "k", "id", "kind")


@query("w14_positions", f"{POSTS} SELECT target, id, row_number() OVER (PARTITION BY target ORDER BY seen, id) AS position FROM posts")
def w14(spark, sf):
    from pyspark.sql import Window as W

    return posts(spark, sf).select("target", "id", F.row_number().over(W.partitionBy("target").orderBy("seen", "id")).cast("long").alias("position"))


@query("a12_exclusion_counters", f"{POSTS}, l AS (SELECT target, k, arg_max(kind, id) AS reason FROM posts GROUP BY 1, 2) SELECT target, reason, count(*) AS n FROM l GROUP BY 1, 2")
def a12(spark, sf):
    last = posts(spark, sf).groupBy("target", "k").agg(F.max_by("kind", "id").alias("reason"))
    return last.groupBy("target", "reason").agg(F.count("*").alias("n"))


@query("a13_observation_counters", f"{POSTS} SELECT target, count(DISTINCT k) FILTER (kind = 'view') AS viewed, count(DISTINCT k) FILTER (kind <> 'view') AS other, count(DISTINCT k) FILTER (pinned) AS pinned FROM posts GROUP BY 1")
def a13(spark, sf):
    n = lambda test: F.countDistinct(F.when(test, F.col("k")))
    return posts(spark, sf).groupBy("target").agg(n(F.col("kind") == "view").alias("viewed"), n(F.col("kind") != "view").alias("other"), n(F.col("pinned")).alias("pinned"))


@query("a14_coverage", f"{POSTS} SELECT target, min(posted) AS first, max(posted) AS last, count(*) FILTER (posted IS NULL) AS undated FROM posts GROUP BY 1")
def a14(spark, sf):
    return T.coverage(posts(spark, sf))


_GRADE = """CASE WHEN stated = 0 THEN CASE WHEN seen > 0 THEN 'complete' ELSE 'none' END WHEN {a} THEN '{b}' WHEN {c} THEN '{d}' ELSE 'partial' END"""
_REPLIES = f"{POSTS}, g AS (SELECT target, count(*) FILTER (kind = 'view') AS seen, count(*) FILTER (kind IN ('view', 'error')) AS stated, bool_or(k > 98) AS more FROM posts GROUP BY 1)"


def _replies(spark, sf):
    view = F.col("kind") == "view"
    return posts(spark, sf).groupBy("target").agg(F.count_if(view).alias("seen"), F.count_if(view | (F.col("kind") == "error")).alias("stated"), F.bool_or(F.col("k") > 98).alias("more"))


@query("a15_a16_reply_grading", f"{_REPLIES} SELECT target, {_GRADE.format(a='more', b='more_available', c='seen >= stated', d='complete')} AS pages_first, {_GRADE.format(a='seen >= stated', b='complete', c='more', d='more_available')} AS count_first FROM g")
def a15(spark, sf):
    seen, stated, more = F.col("seen"), F.col("stated"), F.col("more")
    return _replies(spark, sf).select("target", T.grade(seen, stated, more, True).alias("pages_first"), T.grade(seen, stated, more, False).alias("count_first"))


@query("a37_comments_not_collected", f"{_REPLIES} SELECT target, greatest(0, least(20, stated) - seen) AS missing FROM g")
def a37(spark, sf):
    return _replies(spark, sf).select("target", T.not_collected(F.col("seen"), F.col("stated"), 20).alias("missing"))


@query("a18_relationship_counts", f"{POSTS} SELECT kind, pinned, count(*) AS n FROM posts GROUP BY CUBE (kind, pinned)")
def a18(spark, sf):
    return posts(spark, sf).cube("kind", "pinned").agg(F.count("*").alias("n"))


@query("u14_merge_by_alias", f"""{POSTS} SELECT k, arg_min(posted, id) FILTER (posted IS NOT NULL) AS posted, arg_min(kind, id) AS kind, bool_or(pinned) AS pinned, bool_and(weight > 100) AS dear,
  (SELECT string_agg(target, ',' ORDER BY target) FROM (SELECT k AS k2, target FROM posts GROUP BY 1, 2 QUALIFY row_number() OVER (PARTITION BY k ORDER BY min(id)) <= 50) WHERE k2 = posts.k) AS targets FROM posts GROUP BY 1""")
def u14(spark, sf):
    p = posts(spark, sf).withColumn("dear", F.col("weight") > 100).withColumn("targets", F.array(F.col("target").cast("string")))
    out = T.merged_by_alias(p, "k", "id", ["posted", "kind"], ["pinned"], ["dear"], ["targets"])
    return out.withColumn("targets", F.array_join(F.transform(F.array_sort(F.transform("targets", lambda x: x.cast("long"))), lambda x: x.cast("string")), ","))


@query("u15_fullest_record", f"{POSTS} SELECT k, max(struct_pack(w := weight, o := -id, kind := kind)).kind AS kind, -max(struct_pack(w := weight, o := -id)).o AS id, bool_or(pinned) AS pinned FROM posts GROUP BY 1")
def u15(spark, sf):
    return T.fullest(posts(spark, sf), "k", ["weight"], "id", "pinned").select("k", "kind", "id", "pinned")


_HALVES = f"{POSTS}, o AS (SELECT target, max(posted) AS posted, min(id) AS first_id, arg_max(kind, (posted, id)) AS kind FROM posts WHERE seen < {_FIRST} AND posted IS NOT NULL GROUP BY 1), n AS (SELECT target, max(posted) AS posted, min(id) AS first_id, arg_max(kind, (posted, id)) AS kind FROM posts WHERE seen >= {_FIRST} AND posted IS NOT NULL GROUP BY 1)"


def _state(spark, sf, late: bool):
    p = posts(spark, sf).where((F.col("seen") >= _FIRST) if late else (F.col("seen") < _FIRST)).where("posted IS NOT NULL")
    return p.groupBy("target").agg(F.max("posted").alias("posted"), F.min("id").alias("first_id"), F.max_by("kind", F.struct("posted", "id")).alias("kind"))


@query("u07_post_upsert", f"{_HALVES} SELECT target, coalesce(n.posted, o.posted) AS posted, coalesce(o.first_id, n.first_id) AS first_id FROM o FULL JOIN n USING (target)")
def u07(spark, sf):
    return T.upserted(_state(spark, sf, False), _state(spark, sf, True), "target", ["posted"], ["first_id"])


@query("u08_u10_newer_upsert", f"{_HALVES} SELECT target, greatest(o.posted, n.posted) AS posted, CASE WHEN n.posted >= o.posted OR o.posted IS NULL THEN n.kind ELSE o.kind END AS kind FROM o FULL JOIN n USING (target)")
def u08(spark, sf):
    return T.newer_upsert(_state(spark, sf, False), _state(spark, sf, True), "target", "posted", "kind")


@query("u12_setting_upsert", f"{POSTS} SELECT target, kind, arg_max(weight, (seen, id)) AS weight FROM posts GROUP BY 1, 2")
def u12(spark, sf):
    return posts(spark, sf).groupBy("target", "kind").agg(F.max_by("weight", F.struct("seen", "id")).alias("weight"))


@query("j12_known_ids", f"{POSTS}, known AS (SELECT DISTINCT target, k FROM posts WHERE seen < {_FIRST}) SELECT id FROM posts WHERE seen >= {_FIRST} AND NOT EXISTS (SELECT 1 FROM known WHERE known.target = posts.target AND known.k = posts.k)")
def j12(spark, sf):
    p = posts(spark, sf)
    return p.where(F.col("seen") >= _FIRST).join(p.where(F.col("seen") < _FIRST).select("target", "k").distinct(), ["target", "k"], "left_anti").select("id")


@query("j16_replies_to_roots", "SELECT conv_id AS thread, turn AS id, CASE WHEN turn > 0 THEN CAST(0 AS BIGINT) END AS parent, CAST(0 AS BIGINT) AS root, false AS lost FROM conversations")
def j16(spark, sf):
    c = table(spark, sf, "conversations").select(F.col("conv_id").alias("thread"), F.col("turn").alias("id"), F.when(F.col("turn") > 0, F.lit(0).cast("long")).alias("parent"))
    return T.thread_order(c)


@query("q21_foreign_posts", "SELECT event_id, CASE WHEN event_type = 'error' THEN false ELSE user_id <> 7 END AS other FROM events")
def q21(spark, sf):
    e = table(spark, sf, "events")
    author = F.when(F.col("event_type") != "error", F.col("user_id"))
    return e.select("event_id", T.foreign(author, F.lit(7), F.lit("Name"), F.lit("name")).alias("other"))


@query("x01_newest_first", f"{POSTS} SELECT target, id, posted FROM posts ORDER BY posted DESC NULLS LAST, id")
def x01(spark, sf):
    return posts(spark, sf).select("target", "id", "posted").orderBy(F.desc_nulls_last("posted"), "id")


@query("j08_comment_to_post", "SELECT c.conv_id, c.turn, p.text AS post FROM conversations c LEFT JOIN conversations p ON p.conv_id = c.conv_id AND p.turn = 0 WHERE c.turn > 0")
def j08(spark, sf):
    c = table(spark, sf, "conversations")
    return c.where("turn > 0").select("conv_id", "turn").join(c.where("turn = 0").select("conv_id", F.col("text").alias("post")), "conv_id", "left")
