"""Chat formatting with collapse of cumulative snapshots.

A logger that writes a conversation after every turn leaves many conversations
that are prefixes of longer ones. Every turn gets a rolling hash of the turns
up to it: a sum, so each turn adds its own hash of position, role and text to
the one before. A conversation whose last hash is an inner hash of another is a
prefix of that one and is dropped by an anti-join; of equal conversations the
smallest conv_id stays. What remains is rendered.

Hashes are 128 bits (two sums of 64-bit hashes). Inner hashes and equal
conversations are pre-aggregated to distinct ones before they meet, so a first
turn or a conversation that a third of the log shares is one row in the
anti-join. One conversation's turns are ordered in one task, since its
rendering is one text.

Defined results: turns are ordered by turn (nulls first), then role, then text;
repeated turns count as turns; a null role or text counts as empty; rows with a
null conv_id belong to no conversation and are left out. Marker strings inside
texts are broken up by a backslash. An empty table gives an empty result. Other
columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cairn.llm.common import written

OPEN, CLOSE = "<|im_start|>", "<|im_end|>"
_SUM = "decimal(38,0)"


def prefixes(conversations: DataFrame) -> DataFrame:
    """(conv_id, i, n, s1, s2, role, text): each turn with its position, the conversation's length and its rolling hash."""
    empty = lambda c: F.coalesce(F.col(c), F.lit(""))
    turns = conversations.where("conv_id IS NOT NULL").select("conv_id", "turn", empty("role").alias("role"), empty("text").alias("text"))
    own = W.partitionBy("conv_id")
    order = own.orderBy("turn", "role", "text")
    placed = turns.withColumn("i", F.row_number().over(order)).withColumn("n", F.count("*").over(own))
    rolled = order.rowsBetween(W.unboundedPreceding, 0)
    h = lambda *c: F.xxhash64("i", *c).cast(_SUM)
    return placed.withColumn("s1", F.sum(h("role", "text")).over(rolled)).withColumn("s2", F.sum(h("text", F.lit(1), "role")).over(rolled)).drop("turn")


def maximal(turns: DataFrame) -> DataFrame:
    """(conv_id, copies): conversations that aren't prefixes of longer ones, one of each set of equals; turns: prefixes()."""
    ends = turns.where("i = n").groupBy("n", "s1", "s2").agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("copies"))
    inner = turns.where("i < n").groupBy(F.col("i").alias("n"), "s1", "s2").agg(F.count("*").alias("_longer"))
    return ends.join(inner, ["n", "s1", "s2"], "left_anti").select("conv_id", "copies")


def rendered(turns: DataFrame) -> DataFrame:
    """(conv_id, n_turns, rendered) of whole conversations; turns: (conv_id, i, role, text)."""
    safe = lambda c: F.replace(F.col(c), F.lit("<|im_"), F.lit("<\\|im_"))
    one = F.concat(F.lit(OPEN), safe("role"), F.lit("\n"), safe("text"), F.lit(CLOSE + "\n"))
    lists = turns.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("i", one.alias("t")))).alias("t"))
    return lists.select("conv_id", F.size("t").cast("long").alias("n_turns"), F.array_join(F.transform("t", lambda x: x["t"]), "").alias("rendered"))


def collapsed(conversations: DataFrame) -> DataFrame:
    """(conv_id, n_turns, copies, rendered) for each maximal conversation; copies: equal conversations in the log."""
    turns = written(prefixes(conversations), "chat-turns")
    stay = written(maximal(turns), "chat-stay")
    return rendered(turns.join(stay, "conv_id", "left_semi").select("conv_id", "i", "role", "text")).join(stay, "conv_id").select("conv_id", "n_turns", "copies", "rendered")


ORACLE = r"""
WITH t AS (SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
  row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS i FROM conversations WHERE conv_id IS NOT NULL),
p AS (SELECT *, string_agg(length(role) || ':' || role || length(text) || ':' || text, '') OVER (PARTITION BY conv_id ORDER BY i ROWS UNBOUNDED PRECEDING) AS prefix,
  count(*) OVER (PARTITION BY conv_id) AS n FROM t),
whole AS (SELECT prefix, min(conv_id) AS conv_id, count(*) AS copies FROM p WHERE i = n GROUP BY prefix),
stay AS (SELECT * FROM whole WHERE prefix NOT IN (SELECT prefix FROM p WHERE i < n))
SELECT t.conv_id, count(*) AS n_turns, any_value(copies) AS copies,
  string_agg('<|im_start|>' || replace(role, '<|im_', '<\|im_') || chr(10) || replace(text, '<|im_', '<\|im_') || '<|im_end|>' || chr(10), '' ORDER BY i) AS rendered
FROM t JOIN stay USING (conv_id) GROUP BY t.conv_id
"""
