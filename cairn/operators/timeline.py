"""Timelines of posts: what to select, when to stop, what counts as complete.

Posts are rows (target, id, posted, pinned, ...) with a sequence that says in
which order they were seen. Ordered rules are running values over ranges of a
target's posts (see running); runs are found as islands between resets, so no
loop carries state and no task holds a whole target.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cairn.operators import running


def in_range(posted: Column, first: Column | None, last: Column | None, keep_undated: bool) -> Column:
    """Whether a post lies between two times, both included; undated posts by the platform's rule."""
    ok = F.lit(True)
    if first is not None:
        ok = ok & (posted >= first)
    if last is not None:
        ok = ok & (posted <= last)
    return F.coalesce(ok, F.lit(keep_undated)) if first is not None or last is not None else F.lit(True)


def already_captured(posted: Column, boundary: Column, inclusive: bool) -> Column:
    """Whether a post is older than what the last run reached; inclusive: the boundary itself counts as captured."""
    older = (posted <= boundary) if inclusive else (posted < boundary)
    return F.coalesce(older, F.lit(False))


def newest_per_target(posts: DataFrame) -> DataFrame:
    """(target, id, posted) of the newest post of each target; pinned ones don't count."""
    return posts.where("NOT pinned AND posted IS NOT NULL").groupBy("target").agg(F.max(F.struct("posted", "id")).alias("m")).select("target", "m.id", "m.posted")


def oldest_and_newest(posts: DataFrame) -> DataFrame:
    return posts.where("posted IS NOT NULL").groupBy("target").agg(F.min_by("id", F.struct("posted", "id")).alias("oldest"), F.max_by("id", F.struct("posted", "id")).alias("newest"))


def run_lengths(rows: DataFrame, order: list[str], hit: Column, reset: Column, key: str = "target") -> DataFrame:
    """rows with run: hits since the last reset; rows that are neither leave the run as it is."""
    return running.run_lengths(rows, key, order, hit, reset, "run")


def until_run(rows: DataFrame, order: list[str], hit: Column, reset: Column, most: int, key: str = "target") -> DataFrame:
    """rows up to and with the first one at which a run reaches most; stop marks that one."""
    runs = run_lengths(rows, order, hit, reset, key)
    first = runs.where(F.col("run") >= most).groupBy(key).agg(F.min(F.struct(*order)).alias("_first"))
    at = F.struct(*order)
    kept = running.null_safe_left(runs, first, [key]).where(F.col("_first").isNull() | (at <= F.col("_first")))
    return kept.withColumn("stop", F.coalesce((F.col("run") >= most) & (at == F.col("_first")), F.lit(False))).drop("_first")


def backoff(rows: DataFrame, order: list[str], blocked: Column, factor: float, cooldown: int, most: int, key: str = "target") -> DataFrame:
    """rows with run, the factor by which to slow down, the seconds to wait, and proceed, backoff or stop."""
    runs = run_lengths(rows, order, blocked, ~blocked, key)
    action = F.when(F.col("run") == 0, "proceed").when(F.col("run") >= most, "stop").otherwise("backoff")
    return runs.withColumn("slower", F.pow(F.lit(factor), F.col("run"))).withColumn("wait", F.col("run") * cooldown).withColumn("action", action)


def admitted(posts: DataFrame, order: list[str], most: int) -> DataFrame:
    """The first posts of each target up to most; pinned ones are free."""
    return running.running_sum(posts, "target", order, (~F.col("pinned")).cast("long"), "_n").where(F.col("pinned") | (F.col("_n") <= most)).drop("_n")


def pinned_by_order(posts: DataFrame, order: list[str], first: int = 3, look: int = 5) -> DataFrame:
    """posts with looks_pinned: among the first, older than a post among those that follow up to position look."""
    by = W.partitionBy("target").orderBy(*order)
    placed = posts.withColumn("_i", F.row_number().over(by))
    later = F.max(F.when(F.col("_i") <= look + 1, F.col("posted"))).over(by.rowsBetween(1, look))
    return placed.withColumn("looks_pinned", F.coalesce((F.col("_i") <= first) & (F.col("posted") < later), F.lit(False))).drop("_i")


def capped(rows: DataFrame, key: str, order: list[str], most: int) -> DataFrame:
    """(key, kept, overflow): rows of each key up to most, and those beyond."""
    return rows.groupBy(key).agg(F.least(F.count("*"), F.lit(most)).alias("kept"), F.greatest(F.count("*") - most, F.lit(0)).alias("overflow"))


def first_of(rows: DataFrame, keys: list[str], order: list[str], most: int = 1, parts: int = 64) -> DataFrame:
    """The first rows of each key: of each of its parts first, so no task sorts a whole key."""
    first = lambda df, *by: df.withColumn("_i", F.row_number().over(W.partitionBy(*by).orderBy(*order))).where(F.col("_i") <= most)
    spread = rows.withColumn("_part", F.pmod(F.xxhash64(*order), F.lit(parts)))
    return first(first(spread, *keys, "_part"), *keys).drop("_i", "_part")


def sliding_sum(rows: DataFrame, seconds: Column, amount: Column, span: int, key: str) -> DataFrame:
    """rows with used: the amounts of the last span seconds, the row itself among them."""
    return running.recent_sum(rows, key, seconds, amount, span, "used")


def grade(observed: Column, stated: Column, more: Column, more_first: bool) -> Column:
    """How complete replies are. Platforms differ in whether 'more pages' or 'count reached' is asked first."""
    reached = F.coalesce(observed >= stated, F.lit(False))
    steps = [(more, "more_available"), (reached, "complete")] if more_first else [(reached, "complete"), (more, "more_available")]
    out = F.when(F.coalesce(stated, F.lit(0)) == 0, F.when(observed > 0, "complete").otherwise("none"))
    for test, name in steps:
        out = out.when(test, name)
    return out.otherwise("partial")


def not_collected(counts: Column, stated: Column, cap: int) -> Column:
    """Comments that were to be had and weren't."""
    return F.greatest(F.lit(0), F.least(F.lit(cap), stated) - counts)


def first_rows(rows: DataFrame, key: str, order: list[str], most: int, parts: int = 64) -> DataFrame:
    """The first rows of each key: first of each of its parts, so that no task sorts all rows of a key."""
    cut = rows.withColumn("_part", F.pmod(F.xxhash64(*order), F.lit(parts)))
    for keys in ([key, "_part"], [key]):
        cut = cut.withColumn("_i", F.row_number().over(W.partitionBy(*keys).orderBy(*order))).where(F.col("_i") <= most)
    return cut.drop("_part", "_i")


def merged_by_alias(posts: DataFrame, key: str, order: str, fields: list[str], any_of: list[str], all_of: list[str], lists: list[str], limit: int = 50) -> DataFrame:
    """One row for each key: first value that isn't null, or and and of flags, union of lists in order up to limit."""
    first = lambda c: F.min(F.when(F.col(c).isNotNull(), F.struct(order, c)))[c].alias(c)
    out = posts.groupBy(key).agg(*[first(c) for c in fields], *[F.bool_or(c).alias(c) for c in any_of], *[F.bool_and(c).alias(c) for c in all_of])
    for c in lists:
        items = posts.select(key, order, F.posexplode(c).alias("_at", "_item")).groupBy(key, "_item").agg(F.min(F.struct(order, "_at")).alias("_first"))
        items = first_rows(items.select(key, "_item", "_first.*"), key, [order, "_at"], limit)
        found = items.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct(order, "_at", "_item"))), lambda x: x["_item"]).alias(c))
        out = out.join(found, key, "left").withColumn(c, F.coalesce(c, F.array().cast(posts.schema[c].dataType)))
    return out


def fullest(records: DataFrame, key: str, score: list[str], order: str, flag: str) -> DataFrame:
    """The best-scored record of each key, the first of equals; flag is true if any has it."""
    rest = [c for c in records.columns if c not in (key, flag)]
    best = F.max_by(F.struct(*rest), F.struct(*score, (-F.col(order)).alias("_o")))
    return records.groupBy(key).agg(best.alias("b"), F.bool_or(flag).alias(flag)).select(key, "b.*", flag)


def upserted(old: DataFrame, new: DataFrame, key: str, latest: list[str], first: list[str]) -> DataFrame:
    """old and new rows by key: latest columns are new or else old, first ones old or else new."""
    o, n = old.select(key, *[F.col(c).alias(f"o_{c}") for c in latest + first]), new.select(key, *[F.col(c).alias(f"n_{c}") for c in latest + first])
    return o.join(n, key, "full").select(key, *[F.coalesce(f"n_{c}", f"o_{c}").alias(c) for c in latest], *[F.coalesce(f"o_{c}", f"n_{c}").alias(c) for c in first])


def newer_upsert(old: DataFrame, new: DataFrame, key: str, by: str, value: str) -> DataFrame:
    """The value with the larger of old and new by, the new one on ties."""
    both = old.select(key, by, value, F.lit(0).alias("_new")).unionByName(new.select(key, by, value, F.lit(1).alias("_new")))
    return both.groupBy(key).agg(F.max(F.struct(by, "_new", value)).alias("m")).select(key, f"m.{by}", f"m.{value}")


def coverage(posts: DataFrame, key: str = "target") -> DataFrame:
    """First and last dates and undated posts of each key."""
    return posts.groupBy(key).agg(F.min("posted").alias("first"), F.max("posted").alias("last"), F.count_if(F.col("posted").isNull()).alias("undated"))


def foreign(author: Column, owner: Column, handle: Column, owner_handle: Column) -> Column:
    """Whether a post is another's: ids decide where both are there, handles otherwise."""
    by_handle = F.lower(handle) != F.lower(owner_handle)
    return F.coalesce(F.when(author.isNotNull() & owner.isNotNull(), author != owner).otherwise(by_handle), F.lit(False))


def thread_order(comments: DataFrame) -> DataFrame:
    """comments (thread, id, parent) with their root and whether that root is there: roots first, replies below them."""
    roots = comments.where("parent IS NULL").select("thread", F.col("id").alias("parent"), F.lit(True).alias("_root"))
    joined = comments.join(roots, ["thread", "parent"], "left")
    return joined.select("thread", "id", "parent", F.coalesce("parent", "id").alias("root"), (F.col("parent").isNotNull() & F.col("_root").isNull()).alias("lost"))
