"""Queries of rollups: orders are jobs, customers' nations collections, line items seeds."""

from __future__ import annotations

from pyspark.sql import functions as F

from cairn.functions import urls as U
from cairn.operators import rollups as R
from cairn.plans.catalog import Catalog
from cairn.plans.inputs import table

query = Catalog()
QUERIES, ORACLE = query.queries, query.sql

JOBS = """WITH jobs AS (SELECT o_orderkey AS job, n_name AS collection, o_orderstatus AS status, epoch_us(o_orderdate) // 1000000 AS updated, CAST(round(o_totalprice * 100) AS BIGINT) AS bytes
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey)"""


def jobs(spark, sf):
    c = table(spark, sf, "customer").join(table(spark, sf, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    o = table(spark, sf, "orders").join(c, F.col("o_custkey") == F.col("c_custkey"))
    return o.select(F.col("o_orderkey").alias("job"), F.col("n_name").alias("collection"), F.col("o_orderstatus").alias("status"), F.unix_timestamp("o_orderdate").alias("updated"), F.round(F.col("o_totalprice") * 100).cast("long").alias("bytes"))


def _flat(m: str):
    return F.array_join(F.transform(F.map_entries(m), lambda x: F.concat(x["key"], F.lit("="), x["value"].cast("string"))), ",")


@query("a05_collection_by_status", f"{JOBS}, s AS (SELECT collection, status, count(*) AS n, max(updated) AS updated FROM jobs GROUP BY 1, 2) SELECT collection, CAST(sum(n) AS BIGINT) AS jobs, string_agg(status || '=' || n, ',' ORDER BY status) AS by_status, max(updated) AS last_activity FROM s GROUP BY 1")
def a05(spark, sf):
    return R.status_rollup(jobs(spark, sf)).withColumn("by_status", _flat("by_status"))


@query("p14_collection_view", f"{JOBS} SELECT collection, count(*) AS jobs, count(*) FILTER (status = 'O') AS active, max(updated) AS last_activity FROM jobs GROUP BY 1")
def p14(spark, sf):
    r = R.status_rollup(jobs(spark, sf))
    return r.select("collection", "jobs", F.coalesce(F.col("by_status")["O"], F.lit(0)).alias("active"), "last_activity")


@query("a06_job_totals", "SELECT l_orderkey AS job, count(*) AS seeds, CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS visited, CAST(sum(l_linenumber) AS BIGINT) AS queued FROM lineitem GROUP BY 1")
def a06(spark, sf):
    p = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("job"), F.col("l_quantity").cast("long").alias("visited"), F.col("l_linenumber").alias("queued"))
    return R.job_totals(p, "job", "visited", "queued")


@query("p13_j09_job_view", f"{JOBS}, t AS (SELECT l_orderkey AS job, count(*) AS seeds, CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS visited FROM lineitem GROUP BY 1) SELECT job, collection, status, coalesce(seeds, 0) AS seeds, coalesce(visited, 0) AS visited, greatest(bytes, coalesce(visited, 0) * 1000) AS size FROM jobs LEFT JOIN t USING (job)")
def p13(spark, sf):
    p = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("job"), F.col("l_quantity").cast("long").alias("visited"))
    t = R.job_totals(p, "job", "visited")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    return jobs(spark, sf).join(t, "job", "left").select("job", "collection", "status", zero("seeds").alias("seeds"), zero("visited").alias("visited"), F.greatest("bytes", zero("visited") * 1000).alias("size"))


@query("a07_x05_captures_by_host", "SELECT regexp_extract(lower(url), '^[a-z]+://([^/?#]*)', 1) AS host, count(*) AS n FROM pages GROUP BY 1 ORDER BY n DESC, host LIMIT 20")
def a07(spark, sf):
    return R.top_hosts(table(spark, sf, "pages").select(U.host(F.col("url")).alias("host")), "host")


@query("a32_pages_by_host", "SELECT regexp_extract(lower(url), '^[a-z]+://([^/?#]*)', 1) AS host, url, count(*) OVER (PARTITION BY regexp_extract(lower(url), '^[a-z]+://([^/?#]*)', 1)) AS n FROM (SELECT DISTINCT url FROM pages)")
def a32(spark, sf):
    """A row for each page with the number of pages of its host: a host's pages are counted, not gathered."""
    p = table(spark, sf, "pages").select(U.host(F.col("url")).alias("host"), "url").distinct()
    return p.join(p.groupBy("host").agg(F.count("*").alias("n")), "host")


@query("a29_collection_impact", f"{JOBS} SELECT collection, count(*) AS jobs, CAST(sum(bytes) AS BIGINT) AS bytes FROM jobs GROUP BY 1")
def a29(spark, sf):
    return R.job_totals(jobs(spark, sf), "collection", "bytes").withColumnRenamed("seeds", "jobs")


@query("j11_later_siblings", f"{JOBS} SELECT job, count(*) OVER (PARTITION BY collection ORDER BY updated RANGE BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) - 1 AS later FROM jobs")
def j11(spark, sf):
    return R.later_siblings(jobs(spark, sf), "collection", "job", "updated")


@query("j10_referring_jobs_named", f"{JOBS} SELECT job, collection, r.r_name AS region FROM jobs LEFT JOIN (SELECT n_name, r_name FROM nation JOIN region ON n_regionkey = r_regionkey) r ON n_name = collection")
def j10(spark, sf):
    names = table(spark, sf, "nation").join(table(spark, sf, "region"), F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("n_name").alias("collection"), F.col("r_name").alias("region"))
    return jobs(spark, sf).join(names, "collection", "left").select("job", "collection", "region")


@query("x03_x08_job_order", f"{JOBS} SELECT collection, arg_min(job, job) FILTER (status = 'O') AS oldest_open, max(job) AS newest FROM jobs GROUP BY 1")
def x03(spark, sf):
    return jobs(spark, sf).groupBy("collection").agg(F.min(F.when(F.col("status") == "O", F.col("job"))).alias("oldest_open"), F.max("job").alias("newest"))


@query("u18_reconciled", f"{JOBS}, s AS (SELECT job, CASE status WHEN 'O' THEN 'running' WHEN 'P' THEN 'stopping' ELSE 'done' END AS status, bytes % 2 = 0 AS alive, updated FROM jobs), w AS (SELECT *, status <> 'done' AND NOT alive AND 883612800 - updated >= 60 AS stale FROM s) SELECT job, CASE WHEN stale AND status = 'stopping' THEN 'stopped' WHEN stale THEN 'failed' ELSE status END AS new_status FROM w")
def u18(spark, sf):
    s = F.when(F.col("status") == "O", "running").when(F.col("status") == "P", "stopping").otherwise("done")
    j = jobs(spark, sf).select("job", s.alias("status"), (F.col("bytes") % 2 == 0).alias("alive"), "updated")
    return R.reconciled(j, F.lit(883612800)).select("job", "new_status")


@query("q30_q40_levels", "SELECT c_custkey, CASE WHEN c_acctbal < 0 THEN 'critical' WHEN c_acctbal < 1000 THEN 'warning' ELSE 'ok' END AS level FROM customer")
def q30(spark, sf):
    return table(spark, sf, "customer").select("c_custkey", R.level_of(F.col("c_acctbal"), 1000.0, 0.0).alias("level"))


@query("q41_thresholds", "SELECT s_suppkey, CASE WHEN s_acctbal BETWEEN 0 AND 5000 THEN s_acctbal ELSE 10.0 END AS used, CASE WHEN s_suppkey % 2 = 0 THEN CAST(s_suppkey % 5000 AS DOUBLE) ELSE 10.0 END AS bad FROM supplier")
def q41(spark, sf):
    said = F.when(F.col("s_suppkey") % 2 == 0, (F.col("s_suppkey") % 5000).cast("string")).otherwise(F.col("s_name"))
    return table(spark, sf, "supplier").select("s_suppkey", R.threshold(F.col("s_acctbal").cast("string"), 10.0, 0, 5000).alias("used"), R.threshold(said, 10.0, 0, 5000).alias("bad"))


@query("u11_progress_update", f"{JOBS} SELECT job, CASE WHEN status = 'O' THEN 'busy' ELSE status END AS status, CASE WHEN status = 'O' THEN bytes ELSE updated END AS updated FROM jobs")
def u11(spark, sf):
    j = jobs(spark, sf).select("job", "status", "updated", "bytes")
    change = j.where("status = 'O'").select("job", F.lit("busy").alias("status"), F.col("bytes").alias("updated"))
    return R.partial_update(j.drop("bytes"), change, "job")


@query("u13_cascade_delete", f"{JOBS} SELECT l_orderkey AS job, count(*) AS left_ FROM lineitem WHERE l_orderkey IN (SELECT job FROM jobs WHERE collection <> 'FRANCE') GROUP BY 1")
def u13(spark, sf):
    gone = spark.createDataFrame([("FRANCE",)], "collection string")
    _, left = R.cascade_deleted(jobs(spark, sf), table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("job")), gone, "collection", "job")
    return left.groupBy("job").agg(F.count("*").alias("left_"))


#: A part's fields: brand of the part, type of its size, and a name for all.
META = """WITH v AS (SELECT p_partkey AS seed, 'brand' AS name, p_brand AS value, 0 AS level, 1 AS pos FROM part UNION ALL SELECT p_partkey, 'type', p_type, 1, 2 FROM part
 UNION ALL SELECT p_partkey, 'brand', p_type, 1, 3 FROM part UNION ALL SELECT p_partkey, 'rights', 'open', 2, 4 FROM part UNION ALL SELECT p_partkey, 'type', p_name, 1, 5 FROM part)"""


def meta(spark, sf):
    p = table(spark, sf, "part")
    row = lambda name, value, level, pos: F.struct(F.lit(name).alias("name"), value.alias("value"), F.lit(level).alias("level"), F.lit(pos).alias("pos"))
    rows = F.array(row("brand", F.col("p_brand"), 0, 1), row("type", F.col("p_type"), 1, 2), row("brand", F.col("p_type"), 1, 3), row("rights", F.lit("open"), 2, 4), row("type", F.col("p_name"), 1, 5))
    return p.select(F.col("p_partkey").alias("seed"), F.explode(rows).alias("r")).select("seed", "r.*")


@query("u16_metadata_inheritance", f"{META} SELECT seed, name, value, level FROM v QUALIFY level = min(level) OVER (PARTITION BY seed, name)")
def u16(spark, sf):
    return R.inherited(meta(spark, sf)).select("seed", "name", "value", "level")


@query("k06_w13_metadata_sheet", f"{META}, i AS (SELECT *, row_number() OVER (PARTITION BY seed, name ORDER BY pos) AS i FROM v) SELECT seed, " + ", ".join(f"max(value) FILTER (name = '{n}' AND i = {i}) AS {n}_{i}" for n in ("brand", "type") for i in (1, 2)) + " FROM i GROUP BY 1")
def k06(spark, sf):
    return R.sheet(meta(spark, sf), ["brand", "type"], 2)


@query("a28_grouped_fields", f"{META}, f AS (SELECT name, value, min(pos * 1000000 + seed) AS pos FROM v GROUP BY 1, 2) SELECT name, string_agg(value, '|' ORDER BY pos) AS vals FROM f GROUP BY 1")
def a28(spark, sf):
    m = meta(spark, sf).withColumn("pos", F.col("pos") * 1000000 + F.col("seed"))
    return R.grouped_fields(m).select("name", F.array_join("values", "|").alias("vals"))


@query("x06_preview", "WITH p AS (SELECT p_brand, list(p_name ORDER BY p_partkey) AS l FROM part GROUP BY 1) SELECT p_brand, CASE WHEN len(l) > 5 THEN array_to_string(l[1:5], ', ') || ' and ' || (len(l) - 5) || ' more' ELSE array_to_string(l, ', ') END AS shown FROM p")
def x06(spark, sf):
    return R.previewed(table(spark, sf, "part"), "p_brand", "p_partkey", "p_name")


@query("a33_page_health", "SELECT user_id, " + ", ".join(f"count(*) FILTER (event_type = '{k}') AS {k}" for k in ("click", "error", "view")) + " FROM events GROUP BY 1")
def a33(spark, sf):
    return table(spark, sf, "events").groupBy("user_id").agg(*[F.count_if(F.col("event_type") == k).alias(k) for k in ("click", "error", "view")])


@query("a22_a23_usage", "SELECT user_id, CAST(sum(CAST(round(value * 100) AS BIGINT)) AS BIGINT) AS cpu, count(*) AS samples FROM events GROUP BY ROLLUP (user_id)")
def a22(spark, sf):
    return table(spark, sf, "events").rollup("user_id").agg(F.sum(F.round(F.col("value") * 100).cast("long")).alias("cpu"), F.count("*").alias("samples"))
