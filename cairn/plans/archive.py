"""Queries over captures and pages of a collection."""

from __future__ import annotations

from pyspark.sql import functions as F

from cairn.operators import captures as C
from cairn.plans.catalog import Catalog
from cairn.plans.inputs import CAPTURES, captures, written

query = Catalog()
QUERIES, ORACLE = query.queries, query.sql

#: Jobs that are taken as deleted where a query needs some.
REMOVED = (0, 3)
_REMOVED = ", ".join(map(str, REMOVED))


def resolved(spark, sf):
    return C.resolved(captures(spark, sf))


def stored(spark, sf):
    """resolved captures, written: what reads them more than once digests the payloads once."""
    return written(resolved(spark, sf), "captures")


def removed(spark):
    return spark.createDataFrame([(j,) for j in REMOVED], "crawl_id long")


_W = f"WITH {CAPTURES}"
_FLAGGED = f"""{_W}, last AS (SELECT url_key, max(id) AS last FROM captures WHERE record_type = 'response' GROUP BY 1),
flagged AS (SELECT c.*, (record_type = 'revisit' AND refers_to IN ({_REMOVED}) AND NOT coalesce(last > id, false)) AS orphaned FROM captures c LEFT JOIN last USING (url_key))"""
_FLAGGED = _FLAGGED.replace("(record_type =", "coalesce(record_type =").replace("false)) AS orphaned", "false), false) AS orphaned")


@query("a01_job_dedup_summary", f"""{_W} SELECT crawl_id, count(*) FILTER (record_type = 'response') AS responses,
  count(*) FILTER (record_type = 'revisit' AND refers_to = crawl_id) AS revisits_within, count(*) FILTER (record_type = 'revisit' AND refers_to <> crawl_id) AS revisits_across,
  CAST(coalesce(sum(length) FILTER (record_type = 'revisit'), 0) AS BIGINT) AS bytes_saved,
  CAST(coalesce(sum(length) FILTER (record_type = 'revisit' AND refers_to <> crawl_id), 0) AS BIGINT) AS bytes_saved_across FROM captures GROUP BY 1""")
def a01(spark, sf):
    return C.job_summary(resolved(spark, sf))


@query("a01_refers_to_jobs", f"{_W} SELECT crawl_id, refers_to, count(*) AS n FROM captures WHERE refers_to <> crawl_id GROUP BY 1, 2")
def a01_jobs(spark, sf):
    return C.refers_to_jobs(resolved(spark, sf))


@query("f89_merged_job_maps", f"{_W} SELECT crawl_id, refers_to, count(*) AS n FROM captures WHERE refers_to <> crawl_id GROUP BY 1, 2")
def f89(spark, sf):
    """The maps of captures with even and odd ids, added up, are the maps of all."""
    r = resolved(spark, sf)
    half = lambda k: C.refers_to_map(r.where(F.col("id") % 2 == k)).withColumnRenamed("refers_to_jobs", f"m{k}")
    none = F.create_map().cast("map<bigint,bigint>")
    maps = half(0).join(half(1), "crawl_id", "full").select("crawl_id", C.merged_maps(F.coalesce("m0", none), F.coalesce("m1", none)).alias("m"))
    return maps.select("crawl_id", F.explode("m").alias("refers_to", "n"))


@query("a03_collection_counts", f"""{_FLAGGED} SELECT count(*) AS records, count(*) FILTER (record_type = 'response') AS originals, count(*) FILTER (record_type = 'revisit') AS revisits,
  count(*) FILTER (orphaned) AS orphaned, CAST(sum(length) FILTER (record_type = 'revisit') AS BIGINT) AS bytes_saved FROM flagged""")
def a03(spark, sf):
    return C.collection_counts(C.flagged(stored(spark, sf), removed(spark)))


@query("a04_referring_into_job", f"""{_FLAGGED} SELECT refers_to AS job, crawl_id, count(*) AS n FROM flagged WHERE record_type = 'revisit' AND NOT orphaned AND refers_to <> crawl_id
  GROUP BY GROUPING SETS ((refers_to, crawl_id), (refers_to))""")
def a04(spark, sf):
    return C.referring_into(C.flagged(stored(spark, sf), removed(spark)))


@query("j02_digest_lookup", f"{_W} SELECT digest, id, crawl_id, url_key FROM captures WHERE record_type = 'response'")
def j02(spark, sf):
    return C.lookup(resolved(spark, sf))


@query("j03_refers_to_resolution", f"{_W} SELECT id, crawl_id, refers_to, coalesce(refers_to IN ({_REMOVED}), false) AS orphaned FROM captures WHERE crawl_id NOT IN ({_REMOVED})")
def j03(spark, sf):
    r = resolved(spark, sf)
    gone = removed(spark)
    return C.forgotten(r, gone).select("id", "crawl_id", "refers_to", "orphaned")


@query("j04_revisit_into_removed_job", f"{_FLAGGED} SELECT id, url_key, refers_to, orphaned FROM flagged WHERE record_type = 'revisit'")
def j04(spark, sf):
    return C.flagged(stored(spark, sf), removed(spark)).where("record_type = 'revisit'").select("id", "url_key", "refers_to", "orphaned")


@query("j13_referenced_jobs", f"{_W} SELECT DISTINCT crawl_id, refers_to FROM captures WHERE refers_to <> crawl_id")
def j13(spark, sf):
    return C.refers_to_jobs(resolved(spark, sf)).select("crawl_id", "refers_to")


@query("w01_latest_capture", f"{_W} SELECT url_key, id, crawl_id, digest, seen_at, length, status FROM captures0 QUALIFY row_number() OVER (PARTITION BY url_key ORDER BY seen_at DESC, id DESC) = 1")
def w01(spark, sf):
    return C.latest(captures(spark, sf))


@query("w02_last_seen", f"{_W} SELECT digest, max(seen_at) AS last_seen, arg_max(crawl_id, seen_at) AS crawl_id FROM captures0 GROUP BY 1")
def w02(spark, sf):
    return C.latest(captures(spark, sf), "digest").select("digest", F.col("seen_at").alias("last_seen"), "crawl_id")


@query("w03_earliest_original", f"{_W} SELECT id, min(id) OVER (PARTITION BY digest) AS first_id, arg_min(crawl_id, id) OVER (PARTITION BY digest) AS first_job FROM captures0")
def w03(spark, sf):
    c = captures(spark, sf)
    return c.join(C.originals(c), "digest").select("id", "first_id", "first_job")


@query("u03_forget_job", f"{_W} SELECT crawl_id, count(*) AS left_, count(*) FILTER (refers_to IN ({_REMOVED})) AS orphaned FROM captures WHERE crawl_id NOT IN ({_REMOVED}) GROUP BY 1")
def u03(spark, sf):
    return C.forgotten(resolved(spark, sf), removed(spark)).groupBy("crawl_id").agg(F.count("*").alias("left_"), F.count_if("orphaned").alias("orphaned"))


@query("u01_u04_restored", f"""{_FLAGGED}, back AS (SELECT DISTINCT url_key FROM captures WHERE record_type = 'response' AND crawl_id = 5)
SELECT id, orphaned AND url_key NOT IN (SELECT url_key FROM back) AS orphaned FROM flagged""")
def u04(spark, sf):
    r = stored(spark, sf)
    return C.restored(C.flagged(r, removed(spark)), r.where("record_type = 'response' AND crawl_id = 5")).select("id", "orphaned")


@query("u05_orphans", f"{_FLAGGED} SELECT crawl_id, url_key, seen_at, id FROM flagged WHERE orphaned ORDER BY crawl_id, url_key, seen_at")
def u05(spark, sf):
    return C.flagged(stored(spark, sf), removed(spark)).where("orphaned").select("crawl_id", "url_key", "seen_at", "id").orderBy("crawl_id", "url_key", "seen_at")


@query("a31_distinct_orphan_pages", f"{_FLAGGED} SELECT url_key, crawl_id, seen_at FROM flagged WHERE orphaned QUALIFY row_number() OVER (PARTITION BY url_key ORDER BY crawl_id, seen_at) = 1")
def a31(spark, sf):
    return C.orphan_pages(C.flagged(stored(spark, sf), removed(spark)))


@query("u06_rebuild_index", f"""{_W} SELECT id, crawl_id, CASE WHEN record_type = 'revisit' THEN refers_to END AS refers_to, false AS orphaned FROM captures""")
def u06(spark, sf):
    r = resolved(spark, sf).select("id", "crawl_id", "record_type", "refers_to_id")
    return C.rebuilt(r.where("record_type = 'response'").drop("refers_to_id"), r.where("record_type = 'revisit'")).select("id", "crawl_id", "refers_to", "orphaned")


@query("k14_prune_unreferenced", f"{_W} SELECT id, digest FROM captures WHERE record_type = 'response' AND id NOT IN (SELECT refers_to_id FROM captures WHERE refers_to_id IS NOT NULL)")
def k14(spark, sf):
    return C.unreferenced(resolved(spark, sf)).select("id", "digest")


@query("k08_media_store", f"{_W} SELECT substr(digest, 6) || '.bin' AS name, min(id) AS id, arg_min(length, id) AS length FROM captures0 GROUP BY digest")
def k08(spark, sf):
    return C.media_store(captures(spark, sf))


@query("k16_summary_merge", f"""{_W} SELECT count(*) FILTER (record_type = 'response') AS responses, count(*) FILTER (record_type = 'revisit') AS revisits,
  CAST(sum(length) FILTER (record_type = 'revisit') AS BIGINT) AS bytes_saved FROM captures""")
def k16(spark, sf):
    return C.job_summary(resolved(spark, sf)).agg(F.sum("responses").alias("responses"), F.sum(F.col("revisits_within") + F.col("revisits_across")).alias("revisits"), F.sum("bytes_saved").alias("bytes_saved"))


@query("j26_start_groups", f"""{_W}, g AS (SELECT url_key, crawl_id, max(seen_at) AS seen_at FROM captures0 GROUP BY 1, 2)
SELECT url_key, array_to_string(list(crawl_id ORDER BY seen_at DESC, crawl_id DESC), ',') AS jobs, max(seen_at) AS newest FROM g GROUP BY 1""")
def j26(spark, sf):
    return C.start_groups(captures(spark, sf)).withColumn("jobs", F.array_join(F.transform("jobs", lambda x: x.cast("string")), ","))


@query("a17_statuses", f"{_W} SELECT status, count(*) AS n FROM captures0 GROUP BY 1")
def a17(spark, sf):
    return captures(spark, sf).groupBy("status").agg(F.count("*").alias("n"))


# ---- pages ---------------------------------------------------------------------

_PREV = """SELECT c.id, c.url_key, c.crawl_id, c.status, c.digest, max(struct_pack(seen_at := p.seen_at, id := p.id, crawl_id := p.crawl_id, status := p.status, digest := p.digest)) AS prev
FROM captures0 c LEFT JOIN captures0 p ON p.url_key = c.url_key AND p.crawl_id < c.crawl_id GROUP BY ALL"""
_EVENTS = f"""{_W}, w AS ({_PREV}),
events AS (SELECT *, prev.crawl_id AS previous_job, CASE WHEN status IN (404, 410) THEN CASE WHEN prev.status = 200 THEN 'gone' END
  WHEN coalesce(prev.status, 0) <> 200 THEN 'new' WHEN prev.digest = digest THEN 'unchanged' ELSE 'changed' END AS change FROM w)"""


@query("j06_previous_page", f"{_W}, w AS ({_PREV}) SELECT id, prev.crawl_id AS previous_job, prev.id AS previous_id FROM w")
def j06(spark, sf):
    return C.with_previous(captures(spark, sf)).select("id", F.col("prev.crawl_id").alias("previous_job"), F.col("prev.id").alias("previous_id"))


@query("w04_h02_page_changes", f"{_EVENTS} SELECT id, url_key, crawl_id, change, previous_job FROM events")
def w04(spark, sf):
    return C.classified(captures(spark, sf)).select("id", "url_key", "crawl_id", "change", "previous_job")


@query("a02_page_counts", f"""{_EVENTS} SELECT crawl_id, {", ".join(f"count(DISTINCT url_key) FILTER (change = '{k}') AS {k}" for k in ("new", "changed", "unchanged", "gone"))}
FROM events WHERE change IS NOT NULL GROUP BY 1""")
def a02(spark, sf):
    return C.change_counts(C.classified(captures(spark, sf)))


_MISSED = f"""{_W}, jobs AS (SELECT DISTINCT crawl_id AS job FROM captures0),
last AS (SELECT job, url_key, crawl_id AS last_job, seen_at AS last_seen, status FROM jobs JOIN captures0 ON crawl_id < job QUALIFY row_number() OVER (PARTITION BY job, url_key ORDER BY seen_at DESC, id DESC) = 1),
missed AS (SELECT job AS crawl_id, url_key, last_job, last_seen FROM last WHERE status = 200 AND NOT EXISTS (SELECT 1 FROM captures0 v WHERE v.crawl_id = last.job AND v.url_key = last.url_key))"""


@query("j05_pages_not_visited", f"{_MISSED} SELECT * FROM missed")
def j05(spark, sf):
    return C.not_visited(captures(spark, sf))


@query("a08_change_report_counts", f"{_MISSED} SELECT crawl_id, count(*) AS not_visited FROM missed GROUP BY 1")
def a08(spark, sf):
    return C.not_visited(captures(spark, sf)).groupBy("crawl_id").agg(F.count("*").alias("not_visited"))


@query("j01_fingerprint_lookup", f"{_W} SELECT c.id, p.digest AS fingerprint FROM captures0 c JOIN captures0 p ON p.url_key = c.url_key AND p.crawl_id = c.crawl_id AND p.seen_at = c.seen_at")
def j01(spark, sf):
    c = captures(spark, sf)
    pages = c.groupBy("url_key", "crawl_id", "seen_at").agg(F.min_by("digest", "id").alias("fingerprint"))
    return c.join(pages, ["url_key", "crawl_id", "seen_at"]).select("id", "fingerprint")
