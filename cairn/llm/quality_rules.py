"""Quality rules by weak supervision.

Rules look at counts of a text and vote for keeping it, against it, or
abstain. How often each rule is right isn't given: expectation-maximisation
over the vote patterns of the whole corpus estimates, for each rule, how often
it votes for good texts and against bad ones where it votes, together with the
share of good texts. A text stays if its posterior probability of being good
reaches KEEP, instead of having to pass every rule. Two accuracies for a rule,
since one that is silent on most bad texts can still be almost sure where it
votes against one.

Only DataFrame operations; words, windows and lines of a text are arrays, and a
text's repeated windows are found by sorting its own array. What reaches the
driver is one row for each pattern of votes, at most 3 to the number of rules.

Defined results: a null or empty text has no words, so base_failed is true and
it isn't kept. Repeated rows and null doc_ids are rows like others. A corpus
without votes keeps the starting estimates. Other columns are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cairn.llm.common import SPACE, written

KEEP, ROUNDS = 0.5, 60
#: Starting estimates: a rule's accuracies on good and on bad texts, and the share of good texts. They
#: count as votes on a share PRIOR of all texts: rules are written so that they seldom fire on good ones.
ON_GOOD, ON_BAD, GOOD, PRIOR = 0.995, 0.3, 0.85, 0.5
WINDOW = 8


def let(value: Column, body) -> Column:
    """body(value) with value computed once: lambdas compute what they name anew for each element."""
    return F.transform(F.array(value), body)[0]


def _covered(windows: Column) -> Column:
    """Words covered by windows whose hash occurs twice or more; windows: hashes in order of position."""

    def of_sorted(pairs: Column) -> Column:
        n = F.size(pairs)
        hash_at = lambda i: F.get(pairs, i)["h"]
        again = F.filter(pairs, lambda x, i: (F.coalesce(hash_at(i - 1) == x["h"], F.lit(False))) | (F.coalesce(F.when(i + 1 < n, hash_at(i + 1) == x["h"]), F.lit(False))))
        return let(F.sort_array(F.transform(again, lambda x: x["i"])), steps)

    def steps(at: Column) -> Column:
        gaps = F.zip_with(at, F.slice(at, 2, F.greatest(F.size(at) - 1, F.lit(0))), lambda a, b: F.least(F.coalesce(b - a, F.lit(WINDOW)), F.lit(WINDOW)))
        return F.aggregate(gaps, F.lit(0), lambda s, x: s + x)

    return let(F.array_sort(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i")))), of_sorted)


def features(docs: DataFrame) -> DataFrame:
    """Counts of each text (doc_id, text)."""
    text = F.coalesce(F.col("text"), F.lit(""))
    d = docs.select("doc_id", text.alias("text"))
    d = d.withColumn("words", F.filter(F.split("text", SPACE + "+"), lambda w: w != ""))
    d = d.withColumn("lines", F.filter(F.split("text", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")))
    d = d.select(
        "doc_id",
        F.size("words").cast("long").alias("n_words"),
        F.length(F.array_join("words", "")).cast("long").alias("word_chars"),
        (F.length("text") - F.length(F.regexp_replace("text", r"[#*$%&|<>]+", ""))).cast("long").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.size("lines").cast("long").alias("n_lines"),
        (F.length("text") - F.length(F.regexp_replace("text", r"[A-Z]+", ""))).cast("long").alias("n_upper"),
        F.length(F.regexp_replace("text", r"[^\p{L}]+", "")).cast("long").alias("n_letters"),
        F.transform("words", lambda w: F.xxhash64(w)).alias("h"),
    )
    pair = lambda a, k: F.zip_with(a, F.slice(a, k + 1, F.greatest(F.size(a) - k, F.lit(0))), lambda x, y: F.xxhash64(x, y))
    d = d.withColumn("n_unique", F.size(F.array_distinct("h")).cast("long"))
    d = d.withColumn("h2", pair(F.col("h"), 1)).drop("h")
    d = d.withColumn("h4", pair(F.col("h2"), 2)).drop("h2")
    d = d.withColumn("h8", F.slice(pair(F.col("h4"), 4), F.lit(1), F.greatest(F.col("n_words").cast("int") - (WINDOW - 1), F.lit(0)))).drop("h4")
    repeated = F.size(F.array_distinct("h8")) < F.size("h8")
    return d.withColumn("n_repeat_words", F.when(repeated, _covered(F.col("h8"))).otherwise(F.lit(0)).cast("long")).drop("h8")


def rules() -> dict[str, tuple[Column, Column]]:
    """Each rule as (votes against, votes for); neither is to abstain."""
    c = F.col
    return {
        "length": (c("n_words") < 20, (c("n_words") >= 50) & (c("n_words") <= 200000)),
        "word_length": ((c("word_chars") < 2 * c("n_words")) | (c("word_chars") > 15 * c("n_words")), (c("word_chars") >= 3 * c("n_words")) & (c("word_chars") <= 11 * c("n_words"))),
        "symbols": (10 * c("n_symbols") > c("n_words"), 100 * c("n_symbols") <= c("n_words")),
        "letters": ((100 * c("n_letters") < 88 * c("word_chars")) & (c("n_words") >= 60), 100 * c("n_letters") >= 93 * c("word_chars")),
        "lines": (2 * c("n_dup_lines") > c("n_lines"), (c("n_dup_lines") == 0) & (c("n_lines") >= 2)),
        "repeats": (4 * c("n_repeat_words") > c("n_words"), (20 * c("n_repeat_words") <= c("n_words")) & (c("n_words") >= 50)),
        "upper": (5 * c("n_upper") > c("word_chars"), 20 * c("n_upper") <= c("word_chars")),
        "variety": ((4 * c("n_unique") < c("n_words")) & (c("n_words") < 2000), (2 * c("n_unique") > c("n_words")) & (c("n_words") >= 20)),
    }


def votes(counts: DataFrame) -> DataFrame:
    """counts with a vote (-1, 0 or 1) for each rule; only texts with words are voted on."""
    some = F.col("n_words") > 0
    return counts.withColumns({f"v_{k}": F.when(some & against, -1).when(some & favour, 1).otherwise(0) for k, (against, favour) in rules().items()})


def estimate(patterns: list[tuple[tuple[int, ...], int]], n_rules: int) -> tuple[float, list[tuple[float, float]]]:
    """The share of good texts and each rule's accuracies on good and bad texts, by EM over (votes, texts)."""
    good, acc = GOOD, [(ON_GOOD, ON_BAD)] * n_rules
    prior = max(1.0, PRIOR * sum(n for _, n in patterns))
    sure = (prior * GOOD, prior * (1 - GOOD))
    for _ in range(ROUNDS):
        right = [[sure[0] * ON_GOOD, sure[1] * ON_BAD] for _ in range(n_rules)]
        cast = [[*sure] for _ in range(n_rules)]
        mass, total = prior * GOOD, prior
        for pattern, n in patterns:
            p = posterior(pattern, good, acc)
            mass, total = mass + n * p, total + n
            for k, v in enumerate(pattern):
                if v:
                    cast[k][0] += n * p
                    cast[k][1] += n * (1 - p)
                    right[k][v < 0] += n * (p if v > 0 else 1 - p)
        good = min(max(mass / total, 0.01), 0.99)
        acc = [tuple(min(max(r / c, 1e-4), 1 - 1e-4) for r, c in zip(rs, cs, strict=True)) for rs, cs in zip(right, cast, strict=True)]
    return good, acc


def weights(accuracies: tuple[float, float]) -> tuple[float, float]:
    """What a rule's vote against and its vote for add to the log-odds of good."""
    a, b = accuracies
    return math.log((1 - a) / b), math.log(a / (1 - b))


def posterior(pattern: tuple[int, ...], good: float, acc: list[tuple[float, float]]) -> float:
    z = math.log(good / (1 - good)) + sum(weights(a)[v > 0] for v, a in zip(pattern, acc, strict=True) if v)
    return 1 / (1 + math.exp(-max(min(z, 500), -500)))


def judged(docs: DataFrame) -> DataFrame:
    """Counts, votes, base_failed, posterior and kept for each row of docs (doc_id, text)."""
    rated = written(votes(features(docs.select("doc_id", "text"))), "rules-votes")
    names = [f"v_{k}" for k in rules()]
    found = rated.groupBy(*names).agg(F.count("*").alias("n")).orderBy(*names).collect()  # at most 3 ** rules rows
    good, acc = estimate([(tuple(r[:-1]), r["n"]) for r in found], len(names))
    z = F.lit(math.log(good / (1 - good)))
    for k, a in zip(names, acc, strict=True):
        against, favour = weights(a)
        z = z + F.when(F.col(k) < 0, F.lit(against)).when(F.col(k) > 0, F.lit(favour)).otherwise(F.lit(0.0))
    failed = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    out = rated.withColumn("posterior", 1 / (1 + F.exp(-z))).withColumn("base_failed", failed)
    return out.withColumn("kept", ~F.col("base_failed") & (F.col("posterior") >= KEEP))
