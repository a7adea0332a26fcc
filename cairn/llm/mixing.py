"""Mixing sources to target weights by hierarchical budgeting.

Documents hang on a tree domain - language - source. A budget of tokens flows
from the root: each family of children divides its parent's budget by weight, a
child takes no more than its subtree can give (its tokens times the allowed
epochs), and what it can't take goes to its siblings. Capacities are summed
bottom-up first, so a shortage stays among siblings as long as they can take it
and only what a whole family can't take reaches the family's own siblings. Each
leaf then takes whole epochs, and of one more epoch a prefix of its documents
in an order seeded for that epoch, up to its budget.

Only DataFrame operations, in whole numbers. The prefix of a leaf is found in
two steps, by sums over BUCKETS ranges of the order and within one range, so no
task orders a whole leaf, and a leaf that holds a third of all rows is one of
many keys.

Defined results: null lang or source counts as the empty string; a null or
empty text has 0 tokens and is taken as long as its prefix is; a null doc_id is
ordered as the empty string. Documents with equal order keys (repeated
doc_ids) are taken together or not at all. A weight that is not given is 1; a
weight of 0 gives nothing. Without tokens or budget nothing is taken, but an
epoch of a leaf without tokens is free and is taken once if the leaf's weights
are not 0. An empty table gives an empty result. Other columns are kept.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cairn.llm.common import SPACE, fits, fresh, written

LEVELS = ("domain", "lang", "source")
SEED, MAX_EPOCHS = 17, 2
#: Target weights; a domain is a group of sources.
WEIGHTS: dict[str, Mapping[str, int]] = {"domain": {"0": 4, "1": 3, "2": 2, "3": 1}, "lang": {"en": 4, "de": 2, "fr": 2, "es": 2}, "source": {}}
#: Ranges of the order: the first hexadecimal digits of its key.
DIGITS = 3
BUCKETS = 16**DIGITS
_BIG = "decimal(38,0)"


def domain_of(source: Column) -> Column:
    """The domain of a source where none is given: one of four, by the first digit of its md5."""
    digit = F.substring(F.md5(F.coalesce(source, F.lit(""))), 1, 1)
    return F.when(digit < "4", "0").when(digit < "8", "1").when(digit < "c", "2").otherwise("3")


def n_tokens(text: Column) -> Column:
    """Words of the text."""
    inner = F.regexp_replace(F.coalesce(text, F.lit("")), f"^{SPACE}+|{SPACE}+$", "")
    return F.when(inner == "", F.lit(0)).otherwise(F.size(F.split(inner, SPACE + "+"))).cast("long")


def order_key(doc_id: Column, epoch: Column, seed: int) -> Column:
    return F.md5(F.concat(F.lit(f"{seed}:"), epoch.cast("string"), F.lit(":"), F.coalesce(doc_id.cast("string"), F.lit(""))))


def _weight(level: str, weights: Mapping[str, Mapping[str, int]]) -> Column:
    out = F.lit(None)
    for value, w in weights.get(level, {}).items():
        out = F.when(F.col(level) == value, F.lit(int(w))).otherwise(out)
    return F.coalesce(out, F.lit(1)).cast(_BIG)


def shared_out(children: DataFrame, parent: list[str]) -> DataFrame:
    """children (w, cap, and budget of the parent) with their share x of that budget.

    x = min(cap, level * w) for the level at which the family's shares sum to
    the budget, or cap if the family can't take it all.
    """
    ratio = F.when(F.col("w") > 0, F.col("cap").cast("double") / F.col("w").cast("double"))
    family = W.partitionBy(*parent)
    upto = family.orderBy("r", "name").rowsBetween(W.unboundedPreceding, 0)
    rows = children.withColumn("r", ratio).where("w > 0")
    rows = rows.withColumn("cap_upto", F.sum("cap").over(upto)).withColumn("w_after", F.sum("w").over(family) - F.sum("w").over(upto))
    full = F.col("cap_upto") * F.col("w") + F.col("cap") * F.col("w_after") <= F.col("budget") * F.col("w")
    rows = rows.withColumn("full", full)
    left = F.col("budget") - F.coalesce(F.sum(F.when(F.col("full"), F.col("cap"))).over(family), F.lit(0))
    open_w = F.sum(F.when(~F.col("full"), F.col("w"))).over(family)
    rows = rows.withColumn("left", left.cast(_BIG)).withColumn("open_w", open_w.cast(_BIG))
    return rows.withColumn("x", F.when(F.col("full"), F.col("cap")).otherwise(F.expr("CAST((`left` * w) div open_w AS decimal(38,0))")).cast(_BIG))


def budgets(leaves: DataFrame, total: int | None, weights: Mapping[str, Mapping[str, int]] = WEIGHTS, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """(domain, lang, source, tokens, budget) of leaves (domain, lang, source, tokens).

    total: tokens to be taken; None means as many as there are.
    """
    own = leaves.withColumn("cap", (F.col("tokens") * max_epochs).cast(_BIG))
    # A node whose weight is 0 can give nothing, nor can its descendants.
    for level in LEVELS:
        own = own.withColumn(f"w_{level}", _weight(level, weights))
    own = own.withColumn("cap", F.when((F.col("w_domain") > 0) & (F.col("w_lang") > 0) & (F.col("w_source") > 0), F.col("cap")).otherwise(F.lit(0).cast(_BIG)))
    wanted = F.lit(total).cast(_BIG) if total is not None else F.sum("tokens").cast(_BIG)
    root = own.agg(F.least(F.coalesce(wanted, F.lit(0).cast(_BIG)), F.coalesce(F.sum("cap"), F.lit(0)).cast(_BIG)).alias("budget"))
    parent: list[str] = []
    given = root
    for depth, level in enumerate(LEVELS):
        path = list(LEVELS[: depth + 1])
        nodes = own.groupBy(*path).agg(F.sum("cap").cast(_BIG).alias("cap"), F.max(f"w_{level}").alias("w")).withColumn("name", F.col(level))
        # The root's one row goes to every domain; below, children meet their own parent.
        nodes = nodes.join(given, parent) if parent else nodes.withColumn("_one", F.lit(1)).join(F.broadcast(given.withColumn("_one", F.lit(1))), "_one").drop("_one")
        given = shared_out(nodes, parent or ["_all"]) if parent else shared_out(nodes.withColumn("_all", F.lit(0)), ["_all"])
        given = given.select(*path, F.col("x").alias("budget"))
        parent = path
    return leaves.join(given, list(LEVELS)).select(*LEVELS, "tokens", F.col("budget").cast("long").alias("budget"))


def selection(docs: DataFrame, total: int | None = None, weights: Mapping[str, Mapping[str, int]] = WEIGHTS, max_epochs: int = MAX_EPOCHS, seed: int = SEED, domain: Callable[[Column], Column] = domain_of) -> DataFrame:
    """(doc_id, domain, lang, source, n_tokens, copies) for each row of docs; copies: the times it is taken. domain: of a source."""
    lang, source = F.coalesce("lang", F.lit("")), F.coalesce("source", F.lit(""))
    sized = written(docs.select("doc_id", domain(F.col("source")).alias("domain"), lang.alias("lang"), source.alias("source"), n_tokens(F.col("text")).alias("n_tokens")), "mix-sized")
    cut = written(cuts(sized, total, weights, max_epochs, seed), "mix-cuts")
    return taken(sized, cut, seed).select("doc_id", *LEVELS, "n_tokens", "copies")


def cuts(sized: DataFrame, total: int | None, weights: Mapping[str, Mapping[str, int]] = WEIGHTS, max_epochs: int = MAX_EPOCHS, seed: int = SEED) -> DataFrame:
    """For each leaf its whole epochs, and the last order key of the prefix of the next epoch (null: none)."""
    leaves = written(sized.groupBy(*LEVELS).agg(F.sum("n_tokens").alias("tokens")), "mix-leaves")
    plan = written(budgets(leaves, total, weights, max_epochs), "mix-budgets")
    plan = plan.withColumn("whole", F.when(F.col("tokens") > 0, F.expr("budget div tokens")).otherwise(F.lit(1)).cast("long"))
    plan = plan.withColumn("rest", F.when(F.col("tokens") > 0, F.col("budget") - F.col("whole") * F.col("tokens")).otherwise(F.lit(-1)))
    keyed = meet(sized, plan.select(*LEVELS, "whole", "rest")).withColumn("key", order_key(F.col("doc_id"), F.col("whole"), seed))
    keyed = keyed.withColumn("bucket", F.substring("key", 1, DIGITS))
    # Equal keys are one step of the order.
    steps = keyed.groupBy(*LEVELS, "rest", "bucket", "key").agg(F.sum("n_tokens").alias("n_tokens"))
    by_range = W.partitionBy(*LEVELS).orderBy("bucket")
    ranges = steps.groupBy(*LEVELS, "bucket").agg(F.sum("n_tokens").alias("sum"))
    ranges = ranges.withColumn("before", F.sum("sum").over(by_range) - F.col("sum")).drop("sum")
    within = W.partitionBy(*LEVELS, "bucket").orderBy("key").rowsBetween(W.unboundedPreceding, 0)
    placed = steps.withColumn("sofar", F.sum("n_tokens").over(within)).join(ranges, [*LEVELS, "bucket"])
    last = placed.where(F.col("before") + F.col("sofar") <= F.col("rest")).groupBy(*LEVELS).agg(F.max("key").alias("last_key"))
    return plan.join(last, list(LEVELS), "left").select(*LEVELS, "whole", "last_key")


def meet(rows: DataFrame, leaves: DataFrame) -> DataFrame:
    """rows with their leaf's columns; a large table of leaves is shuffled, and Spark splits a leaf with many rows."""
    return rows.join(F.broadcast(leaves) if fits(leaves) else leaves, list(LEVELS))


def taken(rows: DataFrame, cut: DataFrame, seed: int = SEED) -> DataFrame:
    """rows with copies, by their leaf's whole epochs and last key."""
    joined = rows.join(F.broadcast(cut) if fits(cut) else cut, list(LEVELS), "left")
    more = order_key(F.col("doc_id"), F.col("whole"), seed) <= F.col("last_key")
    return joined.withColumn("copies", F.coalesce(F.col("whole") + F.coalesce(more, F.lit(False)).cast("long"), F.lit(0).cast("long"))).drop("whole", "last_key")


def mixed_documents(docs: DataFrame, total: int | None = None, weights: Mapping[str, Mapping[str, int]] = WEIGHTS, max_epochs: int = MAX_EPOCHS, seed: int = SEED, domain: Callable[[Column], Column] = domain_of) -> DataFrame:
    """The rows of docs that are taken, each as often as it is, with all their columns."""
    key = {"domain": domain(F.col("source")), "lang": F.coalesce("lang", F.lit("")), "source": F.coalesce("source", F.lit(""))}
    sized = written(docs.select("doc_id", *[c.alias(k) for k, c in key.items()], n_tokens(F.col("text")).alias("n_tokens")), "mix-sized")
    cut = written(cuts(sized, total, weights, max_epochs, seed), "mix-cuts")
    own = {k: fresh(docs, f"_{k}") for k in (*LEVELS, "whole", "last_key", "copy")}
    cut = cut.select(*[F.col(k).alias(own[k]) for k in (*LEVELS, "whole", "last_key")])
    marked = docs.withColumns({own[k]: c for k, c in key.items()})
    joined = marked.join(F.broadcast(cut) if fits(cut) else cut, [own[k] for k in LEVELS])
    more = F.coalesce(order_key(F.col("doc_id"), F.col(own["whole"]), seed) <= F.col(own["last_key"]), F.lit(False)).cast("long")
    copies = F.col(own["whole"]) + more
    return joined.where(copies > 0).withColumn(own["copy"], F.explode(F.sequence(F.lit(1).cast("long"), copies))).select(*docs.columns)


def _share_sql(level: int) -> str:
    """CTE s{level}: the shares of all nodes of a level, from the budgets of the level above."""
    path = ", ".join(LEVELS[: level + 1])
    up = ", ".join(LEVELS[:level]) or "1"
    w = " ".join(f"WHEN '{k}' THEN {v}" for k, v in WEIGHTS[LEVELS[level]].items())
    weight = f"CASE {LEVELS[level]} {w} ELSE 1 END" if w else "1"
    budget = f"(SELECT budget FROM s{level - 1} p WHERE " + " AND ".join(f"p.{c} = n.{c}" for c in LEVELS[:level]) + ")" if level else f"(SELECT least(sum(tokens), sum(tokens) * {MAX_EPOCHS}) FROM leaves)"
    return f"""
n{level} AS (SELECT {path}, CAST(sum(tokens) * {MAX_EPOCHS} AS HUGEINT) AS cap, CAST({weight} AS HUGEINT) AS w FROM leaves GROUP BY {path}),
b{level} AS (SELECT *, {budget} AS budget FROM n{level} n),
a{level} AS (SELECT *, CAST(sum(cap) OVER o AS HUGEINT) AS upto, CAST(sum(w) OVER f - sum(w) OVER o AS HUGEINT) AS later FROM b{level}
  WINDOW f AS (PARTITION BY {up}), o AS (PARTITION BY {up} ORDER BY cap / w, {LEVELS[level]} ROWS UNBOUNDED PRECEDING)),
u{level} AS (SELECT *, upto * w + cap * later <= budget * w AS full_ FROM a{level}),
s{level} AS (SELECT {path}, CASE WHEN full_ THEN cap ELSE
  CAST(((budget - coalesce(sum(CASE WHEN full_ THEN cap END) OVER f, 0)) * w) // sum(CASE WHEN NOT full_ THEN w END) OVER f AS HUGEINT) END AS budget FROM u{level}
  WINDOW f AS (PARTITION BY {up}))"""


#: The whole of selection() for the weights above; a leaf's prefix is one window here.
ORACLE = f"""
WITH words AS (
  SELECT doc_id, coalesce(lang, '') AS lang, coalesce(source, '') AS source, substr(md5(coalesce(source, '')), 1, 1) AS digit,
         CAST(len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS BIGINT) AS n_tokens FROM documents),
sized AS (SELECT doc_id, CASE WHEN digit < '4' THEN '0' WHEN digit < '8' THEN '1' WHEN digit < 'c' THEN '2' ELSE '3' END AS domain, lang, source, n_tokens FROM words),
leaves AS (SELECT domain, lang, source, CAST(sum(n_tokens) AS HUGEINT) AS tokens FROM sized GROUP BY ALL),
{_share_sql(0).strip()},{_share_sql(1)},{_share_sql(2)},
plan AS (SELECT l.*, CASE WHEN tokens > 0 THEN budget // tokens ELSE 1 END AS whole, CASE WHEN tokens > 0 THEN budget % tokens ELSE -1 END AS rest
  FROM leaves l JOIN s2 USING (domain, lang, source)),
keyed AS (SELECT s.*, whole, rest, md5('{SEED}:' || CAST(whole AS VARCHAR) || ':' || coalesce(CAST(doc_id AS VARCHAR), '')) AS k
  FROM sized s JOIN plan USING (domain, lang, source)),
placed AS (SELECT *, sum(n_tokens) OVER (PARTITION BY domain, lang, source ORDER BY k) AS sofar FROM keyed)
SELECT doc_id, domain, lang, source, n_tokens, CAST(whole + CASE WHEN sofar <= rest THEN 1 ELSE 0 END AS BIGINT) AS copies FROM placed
"""
