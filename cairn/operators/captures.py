"""Payload dedup over a collection's captures: originals, revisits, orphans.

Captures are rows (id, crawl_id, url_key, digest, seen_at, length, status); id is the
order of arrival. The first capture of a digest is the original (response), the
later ones are revisits that refer to it. Firsts are found by an aggregate that
combines before it shuffles and a join back, so that a payload that a third of
the captures share is one row on the small side, which Spark can broadcast or
whose partner it can split.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cairn.operators import running
from cairn.sources.shared import written


def originals(captures: DataFrame) -> DataFrame:
    """(digest, first_id, first_job): the earliest capture of each payload."""
    return captures.groupBy("digest").agg(F.min(F.struct("id", "crawl_id")).alias("o")).select("digest", F.col("o.id").alias("first_id"), F.col("o.crawl_id").alias("first_job"))


def resolved(captures: DataFrame) -> DataFrame:
    """captures with record_type, and for revisits the job and capture they refer to."""
    joined = captures.join(originals(captures), "digest")
    again = F.col("id") > F.col("first_id")
    return joined.select(*captures.columns, F.when(again, "revisit").otherwise("response").alias("record_type"), F.when(again, F.col("first_job")).alias("refers_to"), F.when(again, F.col("first_id")).alias("refers_to_id"))


def lookup(captures: DataFrame, orphaned: Column | None = None) -> DataFrame:
    """(digest, id, crawl_id, url_key): the earliest original of each payload that isn't orphaned."""
    usable = captures.where("record_type = 'response'")
    if orphaned is not None:
        usable = usable.where(~orphaned)
    return usable.groupBy("digest").agg(F.min(F.struct("id", "crawl_id", "url_key")).alias("o")).select("digest", "o.*")


def job_summary(captures: DataFrame) -> DataFrame:
    """For each job its originals, its revisits within itself and across jobs, and what they saved."""
    revisit = F.col("record_type") == "revisit"
    across = revisit & (F.col("refers_to") != F.col("crawl_id"))
    within = revisit & F.coalesce(F.col("refers_to") == F.col("crawl_id"), F.lit(True))
    size = F.coalesce("length", F.lit(0))
    return captures.groupBy("crawl_id").agg(
        F.count_if(~revisit).alias("responses"),
        F.count_if(within).alias("revisits_within"),
        F.count_if(across).alias("revisits_across"),
        F.sum(F.when(revisit, size).otherwise(0)).alias("bytes_saved"),
        F.sum(F.when(across, size).otherwise(0)).alias("bytes_saved_across"),
    )


def refers_to_jobs(captures: DataFrame) -> DataFrame:
    """(crawl_id, refers_to, n): revisits of each job into each other job."""
    return captures.where("record_type = 'revisit' AND refers_to <> crawl_id").groupBy("crawl_id", "refers_to").agg(F.count("*").alias("n"))


def refers_to_map(captures: DataFrame) -> DataFrame:
    """(crawl_id, refers_to_jobs): the same as one map for each job."""
    pairs = refers_to_jobs(captures)
    return pairs.groupBy("crawl_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("refers_to", "n")))).alias("refers_to_jobs"))


def merged_maps(a: Column, b: Column) -> Column:
    """Counts of two maps added key by key."""
    return F.map_zip_with(a, b, lambda _, x, y: F.coalesce(x, F.lit(0)) + F.coalesce(y, F.lit(0)))


def collection_counts(captures: DataFrame) -> DataFrame:
    """One row: records, originals, revisits, orphaned, bytes saved."""
    revisit = F.col("record_type") == "revisit"
    return captures.agg(
        F.count("*").alias("records"),
        F.count_if(~revisit).alias("originals"),
        F.count_if(revisit).alias("revisits"),
        F.count_if("orphaned").alias("orphaned"),
        F.coalesce(F.sum(F.when(revisit, F.col("length"))), F.lit(0)).alias("bytes_saved"),
    )


def flagged(captures: DataFrame, removed: DataFrame) -> DataFrame:
    """captures with orphaned: a revisit into a removed job (crawl_id), unless its page was stored in full later.

    A response clears the marks of its page (url_key) set before it; so a revisit
    is orphaned only if no response of its page arrived after it.
    """
    gone = removed.select(F.col("crawl_id").alias("refers_to")).distinct().withColumn("_gone", F.lit(True))
    last = captures.where("record_type = 'response'").groupBy("url_key").agg(F.max("id").alias("_last"))
    marked = captures.join(gone, "refers_to", "left").join(last, "url_key", "left")
    orphaned = F.coalesce("_gone", F.lit(False)) & (F.col("record_type") == "revisit") & ~F.coalesce(F.col("_last") > F.col("id"), F.lit(False))
    return marked.withColumn("orphaned", orphaned).select(*captures.columns, "orphaned")


def forgotten(captures: DataFrame, removed: DataFrame) -> DataFrame:
    """What is left after jobs are deleted: their captures go, revisits into them are orphaned."""
    left = captures.join(removed.select("crawl_id").distinct(), "crawl_id", "left_anti")
    gone = removed.select(F.col("crawl_id").alias("refers_to")).distinct().withColumn("_gone", F.lit(True))
    return left.join(gone, "refers_to", "left").withColumn("orphaned", F.coalesce("_gone", F.lit(False)) & (F.col("record_type") == "revisit")).select(*captures.columns, "orphaned")


def restored(captures: DataFrame, pages: DataFrame) -> DataFrame:
    """captures (with orphaned) whose pages (url_key) were stored again: their marks are cleared."""
    back = pages.select("url_key").distinct().withColumn("_back", F.lit(True))
    return captures.join(back, "url_key", "left").withColumn("orphaned", F.col("orphaned") & F.col("_back").isNull()).select(*captures.columns)


def orphan_pages(captures: DataFrame) -> DataFrame:
    """(url_key, crawl_id, seen_at): each orphaned page once, as its first capture has it."""
    return captures.where("orphaned").groupBy("url_key").agg(F.min(F.struct("crawl_id", "seen_at")).alias("o")).select("url_key", "o.*")


def referring_into(captures: DataFrame) -> DataFrame:
    """(job, crawl_id, n): jobs with intact revisits into a job, and a row with null crawl_id for their sum."""
    pairs = captures.where("record_type = 'revisit' AND NOT orphaned AND refers_to <> crawl_id")
    return pairs.rollup(F.col("refers_to").alias("job"), "crawl_id").agg(F.count("*").alias("n")).where("job IS NOT NULL")


def latest(captures: DataFrame, key: str = "url_key") -> DataFrame:
    """The latest capture of each key, by date and then arrival."""
    rest = [c for c in captures.columns if c != key]
    newest = captures.groupBy(key).agg(F.max(F.struct("seen_at", "id", *[c for c in rest if c not in ("seen_at", "id")])).alias("m"))
    return newest.select(key, "m.*").select(*captures.columns)


def unreferenced(captures: DataFrame) -> DataFrame:
    """Originals that no revisit refers to: what pruning may delete."""
    used = captures.where("record_type = 'revisit'").select(F.col("refers_to_id").alias("id"))
    return captures.where("record_type = 'response'").join(used, "id", "left_anti")


def rebuilt(responses: DataFrame, revisits: DataFrame) -> DataFrame:
    """An index made in two passes: all responses first, then revisits resolved by the record they name.

    A revisit whose record isn't there is orphaned.
    """
    held = responses.select(F.col("id").alias("refers_to_id"), F.col("crawl_id").alias("refers_to"))
    second = revisits.join(held, "refers_to_id", "left").withColumn("orphaned", F.col("refers_to").isNull())
    first = responses.withColumn("refers_to", F.lit(None).cast("long")).withColumn("refers_to_id", F.lit(None).cast("long")).withColumn("orphaned", F.lit(False))
    return first.unionByName(second.select(*first.columns))


def media_store(captures: DataFrame, suffix: str = ".bin") -> DataFrame:
    """(name, id, length): payloads kept once under the name of their digest; the first one wins."""
    first = captures.groupBy("digest").agg(F.min(F.struct("id", "length")).alias("f"))
    return first.select(F.concat(F.substring("digest", 6, 40), F.lit(suffix)).alias("name"), "f.*")


def start_groups(captures: DataFrame) -> DataFrame:
    """(url_key, jobs, newest): captures of each page, newest job first."""
    by = captures.groupBy("url_key", "crawl_id").agg(F.max("seen_at").alias("seen_at"))
    lists = by.groupBy("url_key").agg(F.sort_array(F.collect_list(F.struct("seen_at", "crawl_id")), asc=False).alias("g"))
    return lists.select("url_key", F.transform("g", lambda x: x["crawl_id"]).alias("jobs"), F.col("g")[0]["seen_at"].alias("newest"))


# ---- pages: what changed since an earlier job ---------------------------------


def last_in_job(pages: DataFrame) -> DataFrame:
    """The last capture of each page in each job."""
    return pages.groupBy("url_key", "crawl_id").agg(F.max(F.struct("seen_at", "id", "status", "digest")).alias("m")).select("url_key", "crawl_id", "m.*")


def with_previous(pages: DataFrame) -> DataFrame:
    """pages with prev: the latest capture (200, 404 or 410) by a job of a lower number.

    A running maximum over whole jobs, so jobs that ran side by side don't see
    each other and no pair of captures is formed.
    """
    held = F.col("status").isin(200, 404, 410)
    by_job = pages.where(held).groupBy("url_key", "crawl_id").agg(F.max(F.struct("seen_at", "id", "crawl_id", "status", "digest")).alias("m"))
    earlier = W.partitionBy("url_key").orderBy("crawl_id").rangeBetween(W.unboundedPreceding, -1)
    jobs = pages.select("url_key", "crawl_id").distinct().join(by_job, ["url_key", "crawl_id"], "left").withColumn("prev", F.max("m").over(earlier)).drop("m")
    return pages.join(jobs, ["url_key", "crawl_id"])


def change(status: Column, fingerprint: Column, prev: Column) -> Column:
    """new, changed, unchanged, gone, or null for what is no event of a page."""
    was = F.coalesce(prev["status"] == 200, F.lit(False))
    gone = F.when(was, "gone")
    page = F.when(~was, "new").when(prev["digest"] == fingerprint, "unchanged").otherwise("changed")
    return F.when(status.isin(404, 410), gone).when((status == 200) & fingerprint.isNotNull(), page)


def classified(pages: DataFrame) -> DataFrame:
    """pages with change and the job of the capture compared with."""
    seen = with_previous(pages)
    return seen.withColumn("change", change(F.col("status"), F.col("digest"), F.col("prev"))).withColumn("previous_job", F.col("prev.crawl_id")).drop("prev")


def change_counts(events: DataFrame) -> DataFrame:
    """(crawl_id, new, changed, unchanged, gone): pages of each job by what happened to them."""
    kinds = ["new", "changed", "unchanged", "gone"]
    counts = events.where("change IS NOT NULL").groupBy("crawl_id").pivot("change", kinds).agg(F.countDistinct("url_key"))
    return counts.na.fill(0, kinds)


def missed_intervals(pages: DataFrame) -> DataFrame:
    """(url_key, last_job, last_seen, after, upto): runs of jobs that missed a page that an earlier one held.

    A page that job p held is open until a job visits it or finds it gone; so a
    page's visits in order of jobs give intervals: all jobs after `after` and
    before `upto` missed it, all later ones where upto is null.
    """
    visits = pages.groupBy("url_key", "crawl_id").agg(F.max(F.struct("seen_at", "id", "status")).alias("m"))
    order = W.partitionBy("url_key").orderBy("crawl_id")
    # The latest capture so far by date, not by job.
    seen = visits.withColumn("best", F.max(F.struct("m.seen_at", "m.id", "m.status", "crawl_id")).over(order)).withColumn("upto", F.lead("crawl_id").over(order))
    return seen.where(F.col("best.status") == 200).select("url_key", F.col("best.crawl_id").alias("last_job"), F.col("best.seen_at").alias("last_seen"), F.col("crawl_id").alias("after"), "upto")


def not_visited(pages: DataFrame) -> DataFrame:
    """(crawl_id, url_key, last_job, last_seen): missed_intervals() with a row for each job in them; that is pages times jobs at most.

    Jobs get numbers by ranges, an interval is spread out as numbers, and these
    meet the jobs by equality.
    """
    named = pages.select("crawl_id", F.lit(0).alias("_one")).distinct()
    jobs = written(running.earlier(named, "_one", "crawl_id", "_no").drop("_one"), "jobs")
    edges = lambda c, n: jobs.select(F.col("crawl_id").alias(c), F.col("_no").alias(n))
    missed = missed_intervals(pages).join(edges("after", "_from"), "after").join(edges("upto", "_to"), "upto", "left")
    first, last = F.col("_from") + 1, F.coalesce("_to", jobs.agg(F.count("*")).scalar()) - 1
    spread = missed.where(first <= last).withColumn("_no", F.explode(F.sequence(first, last)))
    return spread.join(jobs, "_no").select("crawl_id", "url_key", "last_job", "last_seen")
