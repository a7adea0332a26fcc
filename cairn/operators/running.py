"""Running values over the ordered rows of a key, without a task that holds a whole key.

Rows are dealt by ranges of key and order, so a key that has a third of all rows
lies in many ranges; rows that are equal in both share one. Running values are
computed within each range, and what comes before a range is a window over one
row for each range. Ranges are found by sampling, so they are written down once.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cairn.sources.shared import written

RANGE = "_range"


def dealt(rows: DataFrame, key: str, order: list[str]) -> DataFrame:
    """rows with their range."""
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartitionByRange(max(parts, 1), F.col(key), *map(F.col, order)).withColumn(RANGE, F.spark_partition_id())


def settled(rows: DataFrame) -> DataFrame:
    """rows of dealt() with their windows, written: another evaluation might deal them otherwise."""
    return written(rows, "ranges")


def within(key: str, order: list[str]) -> W:
    """The rows of a key's range up to each one."""
    return W.partitionBy(key, RANGE).orderBy(*order).rowsBetween(W.unboundedPreceding, 0)


def before(key: str) -> W:
    """The ranges of a key before each one; there are as many as partitions at most."""
    return W.partitionBy(key).orderBy(RANGE).rowsBetween(W.unboundedPreceding, -1)


def null_safe_left(rows: DataFrame, other: DataFrame, keys: list[str]) -> DataFrame:
    """Left join in which null keys meet null keys; other has each combination once."""
    right = other.select(*[F.col(k).alias(f"_other_{k}") for k in keys], *[c for c in other.columns if c not in keys])
    return rows.join(right, reduce(Column.__and__, [rows[k].eqNullSafe(right[f"_other_{k}"]) for k in keys]), "left").drop(*[f"_other_{k}" for k in keys])


def running_sum(rows: DataFrame, key: str, order: list[str], amount: Column, name: str) -> DataFrame:
    """rows with the sum of amount up to and with each row; null amounts count as 0."""
    own = settled(dealt(rows.withColumn("_amount", F.coalesce(amount.cast("long"), F.lit(0).cast("long"))), key, order).withColumn("_own", F.sum("_amount").over(within(key, order))))
    totals = own.groupBy(key, RANGE).agg(F.sum("_amount").alias("_all"))
    carried = totals.select(key, RANGE, F.coalesce(F.sum("_all").over(before(key)), F.lit(0)).alias("_carried"))
    return null_safe_left(own, carried, [key, RANGE]).withColumn(name, F.col("_own") + F.col("_carried")).drop("_amount", "_own", "_carried", RANGE)


def run_lengths(rows: DataFrame, key: str, order: list[str], hit: Column, reset: Column, name: str) -> DataFrame:
    """rows with the hits since the last reset; a row that is neither leaves the run as it is.

    Within a range the run is the hits so far less those at its last reset; before
    a range's first reset what was carried into it comes on top.
    """
    upto = within(key, order)
    marked = dealt(rows.withColumns({"_hit": F.coalesce(hit, F.lit(False)).cast("long"), "_reset": F.coalesce(reset, F.lit(False))}), key, order)
    own = settled(marked.withColumn("_hits", F.sum("_hit").over(upto)).withColumn("_base", F.max(F.when(F.col("_reset"), F.col("_hits"))).over(upto)))
    whole = own.groupBy(key, RANGE).agg(F.max("_hits").alias("_all"), F.max(F.when(F.col("_reset"), F.col("_hits"))).alias("_last"))
    summed = whole.withColumn("_sum", F.coalesce(F.sum("_all").over(before(key)), F.lit(0)))
    carried = summed.select(key, RANGE, (F.col("_sum") - F.coalesce(F.max(F.col("_sum") + F.col("_last")).over(before(key)), F.lit(0))).alias("_carried"))
    out = null_safe_left(own, carried, [key, RANGE])
    run = F.when(F.col("_base").isNull(), F.col("_carried") + F.col("_hits")).otherwise(F.col("_hits") - F.col("_base"))
    return out.withColumn(name, run).drop("_hit", "_reset", "_hits", "_base", "_carried", RANGE)


def earlier(rows: DataFrame, key: str, order: str, name: str) -> DataFrame:
    """rows with how many rows of their key come before them; those that are equal in order don't."""
    own = settled(dealt(rows, key, [order]).withColumn("_own", F.rank().over(W.partitionBy(key, RANGE).orderBy(order)).cast("long") - 1))
    totals = own.groupBy(key, RANGE).agg(F.count("*").alias("_all"))
    carried = totals.select(key, RANGE, F.coalesce(F.sum("_all").over(before(key)), F.lit(0)).alias("_carried"))
    return null_safe_left(own, carried, [key, RANGE]).withColumn(name, F.col("_own") + F.col("_carried")).drop("_own", "_carried", RANGE)


def recent_sum(rows: DataFrame, key: str, at: Column, amount: Column, span: int, name: str) -> DataFrame:
    """rows with the amounts of their key in the last span of at (a whole number), the row itself among them; without an at none.

    A row's window lies in its own stretch of time and the one before, so a key
    is dealt by stretches, and each row is also sent to the next one.
    """
    placed = rows.withColumns({"_at": at.cast("long"), "_amount": amount}).withColumn("_own", F.expr(f"floor(_at / {span})"))
    sent = placed.withColumn("_stretch", F.explode(F.array(F.coalesce("_own", F.lit(-1)), F.coalesce("_own", F.lit(-1)) + 1)))
    near = W.partitionBy(key, "_stretch").orderBy("_at").rangeBetween(-span, 0)
    return sent.withColumn(name, F.sum("_amount").over(near)).where(F.col("_stretch") == F.coalesce("_own", F.lit(-1))).withColumn(name, F.when(F.col("_at").isNotNull(), F.col(name))).drop("_at", "_amount", "_own", "_stretch")
