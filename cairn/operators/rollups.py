"""Rollups of jobs, collections and metadata, and what deletion would touch."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cairn.operators import running

from cairn.operators.timeline import first_rows


def status_rollup(jobs: DataFrame, collection: str = "collection") -> DataFrame:
    """(collection, jobs, by_status, last_activity): jobs of each collection by status."""
    by = jobs.groupBy(collection, "status").agg(F.count("*").alias("n"), F.max("updated").alias("updated"))
    whole = by.groupBy(collection).agg(F.sum("n").alias("jobs"), F.map_from_entries(F.array_sort(F.collect_list(F.struct("status", "n")))).alias("by_status"), F.max("updated").alias("last_activity"))
    return whole


def job_totals(progress: DataFrame, job: str, *sums: str) -> DataFrame:
    return progress.groupBy(job).agg(F.count("*").alias("seeds"), *[F.sum(c).alias(c) for c in sums])


def top_hosts(captures: DataFrame, host: str, most: int = 20) -> DataFrame:
    """The hosts with the most captures, ties by name."""
    return captures.where(F.col(host) != "").groupBy(host).agg(F.count("*").alias("n")).orderBy(F.desc("n"), host).limit(most)


def later_siblings(jobs: DataFrame, group: str, key: str, created: str) -> DataFrame:
    """(key, later): for each job the jobs of its group created at its time or later, itself not counted: all less those that came before."""
    placed = running.earlier(jobs.select(group, key, created), group, created, "_before")
    sizes = placed.groupBy(group).agg(F.count("*").alias("_all"))
    return running.null_safe_left(placed, sizes, [group]).select(key, (F.col("_all") - F.col("_before") - 1).alias("later"))


def inherited(values: DataFrame) -> DataFrame:
    """(seed, name, value) with level (0 seed, 1 job, 2 collection): the values of each name's closest level."""
    near = F.min("level").over(W.partitionBy("seed", "name"))
    return values.withColumn("_near", near).where("level = _near").drop("_near")


def sheet(values: DataFrame, names: list[str], most: int) -> DataFrame:
    """One row for each seed with columns name_1 .. name_most: the values of repeated names in their order."""
    placed = values.withColumn("_i", F.row_number().over(W.partitionBy("seed", "name").orderBy("pos")))
    cells = [f"{n}_{i}" for n in names for i in range(1, most + 1)]
    return placed.where(F.col("_i") <= most).withColumn("_c", F.concat("name", F.lit("_"), "_i")).groupBy("seed").pivot("_c", cells).agg(F.first("value"))


def grouped_fields(values: DataFrame) -> DataFrame:
    """(name, values): distinct values of each name in the order they came."""
    first = values.groupBy("name", "value").agg(F.min("pos").alias("pos"))
    return first.groupBy("name").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "value"))), lambda x: x["value"]).alias("values"))


def preview(items: Column, most: int = 5) -> Column:
    """The first items, and how many more there are."""
    more = F.size(items) - most
    head = F.array_join(F.slice(items, 1, most), ", ")
    return F.when(more > 0, F.concat(head, F.lit(" and "), more.cast("string"), F.lit(" more"))).otherwise(head)


def previewed(rows: DataFrame, key: str, order: str, value: str, most: int = 5) -> DataFrame:
    """(key, shown): the first values of each key and how many more there are; only the first rows of a key are gathered."""
    head = first_rows(rows.select(key, order, value), key, [order], most).groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct(order, value))), lambda x: x[value]).alias("_l"))
    total = rows.groupBy(key).agg(F.count("*").alias("_n"))
    more, shown = F.col("_n") - most, F.array_join("_l", ", ")
    return head.join(total, key).select(key, F.when(more > 0, F.concat(shown, F.lit(" and "), more.cast("string"), F.lit(" more"))).otherwise(shown).alias("shown"))


def reconciled(jobs: DataFrame, now: Column, idle: int = 60) -> DataFrame:
    """jobs (status, alive, updated) with the status that a dead worker's job gets, and why."""
    stale = F.col("status").isin("running", "stopping", "paused") & ~F.col("alive") & (now - F.col("updated") >= idle)
    status = F.when(stale & (F.col("status") == "stopping"), "stopped").when(stale, "failed").otherwise(F.col("status"))
    return jobs.withColumn("new_status", status).withColumn("reason", F.when(stale, "the worker is gone"))


def level_of(free: Column, warning: float, critical: float) -> Column:
    """ok, warning or critical by what is free; unmeasured is ok."""
    return F.when(free < critical, "critical").when(free < warning, "warning").otherwise("ok")


def threshold(setting: Column, default: float, low: float, high: float) -> Column:
    """A setting as a number, or the default if it is none or out of range."""
    x = setting.try_cast("double")
    return F.when(x.between(low, high), x).otherwise(F.lit(default))


def partial_update(current: DataFrame, change: DataFrame, key: str) -> DataFrame:
    """current with the columns of change where they aren't null."""
    cols = [c for c in change.columns if c != key]
    c = change.select(key, *[F.col(x).alias(f"_n_{x}") for x in cols])
    return current.join(c, key, "left").select(*[F.coalesce(f"_n_{x}", x).alias(x) if x in cols else x for x in current.columns])


def cascade_deleted(jobs: DataFrame, progress: DataFrame, gone: DataFrame, collection: str, job: str) -> tuple[DataFrame, DataFrame]:
    """jobs and progress without those of gone collections."""
    left = jobs.join(gone.select(collection).distinct(), collection, "left_anti")
    return left, progress.join(left.select(job), job, "left_semi")
