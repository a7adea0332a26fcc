"""Queries of streams over events, each drained once."""

from __future__ import annotations

from pyspark.sql import functions as F

from cairn.plans.catalog import Catalog
from cairn.plans.inputs import shared_folder, table
from cairn.streaming import states as S
from cairn.streaming.tail import tailed

query = Catalog()
QUERIES, ORACLE = query.queries, query.sql


def _folder(spark) -> str:
    return shared_folder(spark, "stream")


def _events(spark, sf):
    return S.events(spark, f"{sf}/events.parquet").withColumn("blocked", F.col("event_type") == "error")


@query("st1_first_sightings", "SELECT user_id, event_type FROM events GROUP BY 1, 2")
def st1(spark, sf):
    return S.drained(spark, S.first_sightings(_events(spark, sf), ["user_id", "event_type"], "ts", "60 days").select("user_id", "event_type"), _folder(spark))


@query("st4_block_backoff", """WITH h AS (SELECT user_id, event_id, sum(CAST(event_type = 'error' AS INT)) OVER (PARTITION BY user_id ORDER BY event_id) AS hits, event_type FROM events),
r AS (SELECT *, hits - coalesce(max(CASE WHEN event_type <> 'error' THEN hits END) OVER (PARTITION BY user_id ORDER BY event_id), 0) AS run FROM h)
SELECT user_id, event_id, CAST(run AS BIGINT) AS run, CASE WHEN run = 0 THEN 'proceed' WHEN run >= 2 THEN 'stop' ELSE 'backoff' END AS action FROM r""")
def st4(spark, sf):
    return S.drained(spark, S.backoff(_events(spark, sf), "user_id", "event_id", "blocked", 2), _folder(spark))


@query("st3_boundary", """WITH h AS (SELECT user_id, event_id, sum(CAST(value < 9 AS INT)) OVER o AS hits, value < 9 AS older, event_type = 'purchase' AS pinned FROM events WINDOW o AS (PARTITION BY user_id ORDER BY event_id)),
r AS (SELECT *, hits - coalesce(max(CASE WHEN NOT older AND NOT pinned THEN hits END) OVER (PARTITION BY user_id ORDER BY event_id), 0) AS run FROM h),
s AS (SELECT *, coalesce(bool_or(run >= 4) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false) AS past FROM r)
SELECT user_id, event_id, CAST(run AS BIGINT) AS run, run >= 4 AS stop FROM s WHERE NOT past""")
def st3(spark, sf):
    e = _events(spark, sf).withColumn("older", F.col("value") < 9).withColumn("pinned", F.col("event_type") == "purchase")
    return S.drained(spark, S.boundary(e, "user_id", "event_id", "older", "pinned", 4), _folder(spark))


@query("st13_tumbling_windows", "WITH w AS (SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, event_type, count(*) AS n FROM events GROUP BY 1, 2) SELECT start, event_type, n FROM w WHERE start + INTERVAL 1 HOUR <= (SELECT max(ts) FROM events)")
def st13(spark, sf):
    e = _events(spark, sf)
    return S.drained(spark, S.tumbling(e, "ts", "1 hour", "0 seconds", "event_type"), _folder(spark)).withColumn("start", F.col("start").cast("timestamp_ntz"))


@query("st13_session_windows", """WITH o AS (SELECT user_id, ts, coalesce(ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) > INTERVAL 30 MINUTE, true) AS new FROM events),
g AS (SELECT *, sum(CAST(new AS INT)) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS g FROM o)
SELECT user_id, min(ts) AS start_, count(*) AS n FROM g GROUP BY user_id, g HAVING max(ts) + INTERVAL 30 MINUTE <= (SELECT max(ts) FROM events)""")
def st13_sessions(spark, sf):
    out = S.drained(spark, S.sessions(_events(spark, sf), "ts", "30 minutes", "0 seconds", "user_id"), _folder(spark))
    return out.select("user_id", F.col("start").cast("timestamp_ntz").alias("start_"), "n")


@query("s18_st6_tailed_lines", "SELECT event_type, count(*) AS n, CAST(sum(event_id) AS BIGINT) AS ids, CAST(sum(length(props)) AS BIGINT) AS props FROM events GROUP BY 1")
def s18(spark, sf):
    """Log files that grow by new ones between two runs of a stream, read by byte position in several ranges a file."""
    folder = _folder(spark)
    e = table(spark, sf, "events").select("event_id", F.concat_ws(" ", F.col("event_id").cast("string"), "event_type", "props").alias("value"))
    for early in (True, False):
        e.where((F.col("event_id") % 3 == 0) == F.lit(early)).select("value").write.mode("append").text(f"{folder}/in")
        out = S.drained(spark, tailed(spark, f"{folder}/in", "part-*.txt", split=64 << 10), folder)
    part = lambda k: F.regexp_extract("line", "^([0-9]+) ([a-z_]+) (.*)$", k)
    return out.groupBy(part(2).alias("event_type")).agg(F.count("*").alias("n"), F.sum(part(1).cast("long")).alias("ids"), F.sum(F.length(part(3)).cast("long")).alias("props"))
