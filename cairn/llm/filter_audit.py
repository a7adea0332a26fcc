"""Filter interaction audit by a subset-zeta transform.

Every document gets a mask of the filters that it fails. Counts of masks within
a part (32 numbers each for documents, good and toxic ones) are all that the
audit needs: the zeta transform over subsets turns them into the survivors of
every set of filters, and a step of an order of filters is the difference of two
neighbouring sets. Texts are read once; what moves between tasks are short rows
of id, part, mask and digest.

A text is a copy if a smaller doc_id has an identical one. The smallest id of a
digest is an aggregate, and rows meet it by digest and id, not by digest alone,
so a text that a third of the table shares is spread over all tasks.

Defined results: a null text counts as empty, a null part as the empty string.
A row with a null doc_id is no copy, makes none, and has no label. Rows that are
repeated count as often as they are there; those that share the smallest doc_id
and the text are all first. A document is good (toxic) if any row of labels for
its doc_id has quality (toxic) 1; null labels don't count. Texts are told apart
by SHA-256, words within a text by 64-bit hashes. An empty table has no parts
and gives no rows. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import permutations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cairn.llm.common import map_text, word_hashes, word_spans, written

FILTERS = "ABCDE"
SETS = 1 << len(FILTERS)
MIN_WORDS, MIN_DISTINCT, MAX_UPPER = 200, 50, 2
COPY = 1 << FILTERS.index("E")

_SPECIAL = np.zeros(256, bool)
_SPECIAL[list(b"#$%&*|")] = True


def text_failures(buf: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """For each text the mask of filters A to D that it fails."""
    starts, ends, first = word_spans(buf, offs)
    n_words = np.diff(first)
    doc_of = np.repeat(np.arange(len(n_words)), n_words)
    h = word_hashes(buf, starts, ends, lower=False)
    order = np.lexsort((h, doc_of))
    h, doc = h[order], doc_of[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
    distinct = np.bincount(doc[new], minlength=len(n_words))

    def count(which: np.ndarray) -> np.ndarray:
        return np.diff(np.concatenate([[0], np.cumsum(which)])[offs])

    upper, points, special = count((buf >= 65) & (buf <= 90)), count((buf & 0xC0) != 0x80), count(_SPECIAL[buf])
    fails = [n_words < MIN_WORDS, 100 * distinct < MIN_DISTINCT * n_words, 100 * upper > MAX_UPPER * points, special > 0]
    return sum(f.astype(np.int32) << k for k, f in enumerate(fails))


def failures(docs: DataFrame, part: Column) -> DataFrame:
    """(doc_id, part, n, mask): the filters that documents (doc_id, text) fail; n equal rows are one."""
    text = F.coalesce("text", F.lit(""))
    rows = docs.select("doc_id", F.coalesce(part, F.lit("")).alias("part"), F.unhex(F.sha2(text, 256)).alias("digest"), text.alias("text"))
    rows = map_text(rows, "text", [("mask", T.IntegerType())], lambda buf, offs: [text_failures(buf, offs)])
    rows = written(rows.groupBy("doc_id", "part", "digest", "mask").agg(F.count("*").alias("n")), "audit-rows")
    named = rows.where("doc_id IS NOT NULL")
    firsts = named.groupBy("digest").agg(F.min("doc_id").alias("doc_id")).withColumn("first", F.lit(True))
    named = named.join(firsts, ["digest", "doc_id"], "left").withColumn("mask", F.col("mask") + F.when(F.col("first"), 0).otherwise(COPY))
    return named.select("doc_id", "part", "n", "mask").unionByName(rows.where("doc_id IS NULL").select("doc_id", "part", "n", "mask"))


def mask_counts(failed: DataFrame, labels: DataFrame) -> DataFrame:
    """(part, mask, n, good, toxic): how many documents of a part fail just the filters of mask; failed: failures()."""
    known = labels.where("doc_id IS NOT NULL AND (quality = 1 OR toxic = 1)").groupBy("doc_id")
    known = known.agg(F.coalesce(F.max(F.expr("quality = 1")), F.lit(False)).alias("good"), F.coalesce(F.max(F.expr("toxic = 1")), F.lit(False)).alias("toxic"))
    named = failed.where("doc_id IS NOT NULL").join(known, "doc_id", "left")
    nameless = failed.where("doc_id IS NULL").withColumns({"good": F.lit(False), "toxic": F.lit(False)})
    of = lambda c: F.sum(F.when(F.col(c), F.col("n")).otherwise(0)).alias(c)
    return named.unionByName(nameless).groupBy("part", "mask").agg(F.sum("n").alias("n"), of("good"), of("toxic"))


def survivors(counts: np.ndarray) -> np.ndarray:
    """Subset-zeta transform along the last axis: for each set of filters, how many documents fail none of them; counts: by mask."""
    within = counts.reshape(*counts.shape[:-1], *[2] * len(FILTERS))
    for axis in range(1, len(FILTERS) + 1):
        within = np.cumsum(within, axis=-axis)
    return within.reshape(counts.shape)[..., ::-1]  # a text passes a set if its mask lies within the complement


#: (order, step, filter, set before, set after) of every step of every order.
STEPS = [(order, k + 1, FILTERS.index(f), sum(1 << FILTERS.index(x) for x in order[:k]), sum(1 << FILTERS.index(x) for x in order[: k + 1])) for order in map("".join, permutations(FILTERS)) for k, f in enumerate(order)]
COLUMNS = "part string, filter_order string, step int, kept long, removed long, redundant long, unique_fails long, good_lost long, toxic_lost long, shapley long"


def audited(counts: DataFrame) -> DataFrame:
    """A row for each part, order of the filters and step; counts: mask_counts(). A part's counts are one row of 3 x 32 numbers."""
    cell = F.struct("mask", "n", "good", "toxic")
    parts = counts.groupBy("part").agg(F.collect_list(cell).alias("cells"))
    order, step, which, before, after = (np.array(x) for x in zip(*STEPS, strict=True))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for part, cells in zip(frame["part"], frame["cells"], strict=True):
                by_mask = np.zeros((3, SETS), np.int64)
                for c in cells:
                    by_mask[:, c["mask"]] = c["n"], c["good"], c["toxic"]
                left = survivors(by_mask)
                lost = left[:, before] - left[:, after]
                removed = lost[0]
                fails = left[0, 0] - left[0, 1 << which]
                alone = left[0, (SETS - 1) ^ (1 << which)] - left[0, SETS - 1]
                shapley = np.array([removed[which == f].sum() for f in range(len(FILTERS))])[which]
                yield pd.DataFrame({"part": part, "filter_order": order, "step": step.astype(np.int32), "kept": left[0, after], "removed": removed, "redundant": fails - removed, "unique_fails": alone, "good_lost": lost[1], "toxic_lost": lost[2], "shapley": shapley})

    return parts.mapInPandas(run, COLUMNS)


def audit(docs: DataFrame, labels: DataFrame, part: str = "source") -> DataFrame:
    """What every filter removes in every order of the filters, within each value of the column part."""
    return audited(mask_counts(failures(docs, F.col(part)), labels))


ORACLE = r"""
WITH d AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
f AS (SELECT doc_id, part, (len(w) < 200)::int + 2 * (100 * len(list_distinct(w)) < 50 * len(w))::int
  + 4 * (100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 2 * length(text))::int + 8 * regexp_matches(text, '[#$%&*|]')::int
  + 16 * coalesce(doc_id > min(doc_id) OVER (PARTITION BY text), false)::int AS mask FROM d),
l AS (SELECT doc_id, coalesce(bool_or(quality = 1), false) AS good, coalesce(bool_or(toxic = 1), false) AS toxic FROM labels WHERE doc_id IS NOT NULL GROUP BY doc_id),
c AS (SELECT part, mask, count(*) AS n, count(*) FILTER (good) AS good, count(*) FILTER (toxic) AS toxic FROM f LEFT JOIN l USING (doc_id) GROUP BY ALL),
x(name, bit) AS (VALUES ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16)),
o AS (SELECT a.name || b.name || c.name || d.name || e.name AS filter_order, [a.bit, b.bit, c.bit, d.bit, e.bit] AS bits
  FROM x a, x b, x c, x d, x e WHERE a.bit | b.bit | c.bit | d.bit | e.bit = 31),
s AS (SELECT filter_order, step::int AS step, bits[step] AS bit, list_sum(bits[1:step - 1]) AS before FROM o, range(1, 6) r(step)),
t AS (SELECT part, filter_order, step, bit,
  coalesce(sum(n) FILTER (mask & (coalesce(before, 0) | bit)::int = 0), 0)::bigint AS kept,
  coalesce(sum(n) FILTER (mask & coalesce(before, 0)::int = 0 AND mask & bit > 0), 0)::bigint AS removed,
  coalesce(sum(n) FILTER (mask & coalesce(before, 0)::int > 0 AND mask & bit > 0), 0)::bigint AS redundant,
  coalesce(sum(n) FILTER (mask = bit), 0)::bigint AS unique_fails,
  coalesce(sum(good) FILTER (mask & coalesce(before, 0)::int = 0 AND mask & bit > 0), 0)::bigint AS good_lost,
  coalesce(sum(toxic) FILTER (mask & coalesce(before, 0)::int = 0 AND mask & bit > 0), 0)::bigint AS toxic_lost
  FROM c, s GROUP BY ALL)
SELECT * EXCLUDE (bit), (sum(removed) OVER (PARTITION BY part, bit))::bigint AS shapley FROM t
"""
