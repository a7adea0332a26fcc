"""Selecting pages by theme: rules, scores, links and verdicts as column expressions.

Terms and patterns are few and come from a configuration, so they become one
expression that runs where the text is; nothing is joined.
"""

from __future__ import annotations

import hashlib
import json
import re
from dataclasses import asdict, dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Points of a term in the head, in the metadata and in the body, and their caps. Fixed values.
HEAD, HEAD_CAP, META, META_CAP, BODY_CAP, INCLUDED = 3, 9, 2, 6, 5, 3


@dataclass(frozen=True)
class Theme:
    name: str = "theme"
    terms: tuple[str, ...] = ()
    exclude_terms: tuple[str, ...] = ()
    url_include: tuple[str, ...] = ()
    url_exclude: tuple[str, ...] = ()
    hub_patterns: tuple[str, ...] = ()
    date_from: str | None = None
    date_to: str | None = None
    min_score: int = 3
    unsure_action: str = "reject"
    keep_hubs: bool = False
    notes: dict = field(default_factory=dict)

    def fingerprint(self) -> str:
        """A short digest of all settings."""
        return hashlib.sha256(json.dumps(asdict(self), sort_keys=True).encode()).hexdigest()[:16]


def normalised(text: Column) -> Column:
    """Lower case, white space collapsed."""
    return F.trim(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"(?U)\s+", " "))


def term_regex(term: str) -> str:
    """A whole-word pattern that allows plural and tense endings."""

    def one(word: str) -> str:
        if len(word) > 3 and word.endswith("y"):
            return re.escape(word[:-1]) + "(?:y|ies|y's)"
        return re.escape(word) + "(?:'s|s|es|ed|ing)?"

    return r"(?<![\p{L}\p{N}_])" + r"\s+".join(one(w) for w in term.lower().split()) + r"(?![\p{L}\p{N}_])"


def forms(term: str) -> tuple[str, ...]:
    """The words that a term of one word matches; empty if it isn't one word."""
    word = term.lower()
    if not re.fullmatch(r"\w+", word):
        return ()
    return (word, word[:-1] + "ies") if len(word) > 3 and word.endswith("y") else tuple(word + end for end in ("", "s", "es", "ed", "ing"))


def read(theme: Theme, text: Column) -> Column:
    """struct(text, words): a normalised text, and those of its words that a term of the theme matches, found in one pass.

    Make it a column of its own, so that it is computed once for all terms.
    """
    wanted = sorted({f for t in (*theme.terms, *theme.exclude_terms) for f in forms(t)})
    words = F.filter(F.split(text, r"[^\p{L}\p{N}_]+"), lambda w: w.isin(*wanted)) if wanted else F.array().cast("array<string>")
    return F.struct(text.alias("text"), words.alias("words"))


def hits(said: Column, term: str) -> Column:
    """How often a read text has the term."""
    if own := forms(term):
        return F.size(F.filter(said["words"], lambda w: w.isin(*own)))
    return F.regexp_count(said["text"], F.lit(term_regex(term)))


def first_pattern(url: Column, patterns: tuple[str, ...]) -> Column:
    """The first of the patterns that the URL has, or null."""
    out = F.lit(None).cast("string")
    for p in reversed(patterns):
        out = F.when(F.lower(url).rlike(p.lower()), F.lit(p)).otherwise(out)
    return out


def hard_reason(theme: Theme, url: Column, published: Column, head: Column, body: Column) -> Column:
    """Why a page is refused whatever its score, by the first rule that does: URL, dates, excluded terms. head, body: read texts."""
    steps = [F.when(first_pattern(url, theme.url_exclude).isNotNull(), F.lit("url"))]
    if theme.date_from:
        steps.append(F.when(published < F.lit(theme.date_from), F.lit("before")))
    if theme.date_to:
        steps.append(F.when(published > F.lit(theme.date_to), F.lit("after")))
    for term in theme.exclude_terms:
        steps.append(F.when(hits(head, term) > 0, F.lit(f"head:{term}")))
        steps.append(F.when(hits(body, term) >= 3, F.lit(f"body:{term}")))
    return F.coalesce(*steps)


def scores(theme: Theme, url: Column, head: Column, meta: Column, body: Column) -> Column:
    """struct(head, meta, body, score): terms in their order, each counted at the first place with room for it. head, meta, body: read texts."""
    counts = F.array(*[F.struct((hits(head, t) > 0).alias("h"), (hits(meta, t) > 0).alias("m"), F.least(hits(body, t), F.lit(3)).alias("b")) for t in theme.terms]) if theme.terms else F.array().cast("array<struct<h:boolean,m:boolean,b:int>>")
    start = F.struct(F.lit(0).alias("head"), F.lit(0).alias("meta"), F.lit(0).alias("body"))

    def add(acc: Column, x: Column) -> Column:
        in_head = x["h"] & (acc["head"] < HEAD_CAP)
        in_meta = ~in_head & x["m"] & (acc["meta"] < META_CAP)
        in_body = ~in_head & ~in_meta
        more = lambda test, old, new: F.when(test, new).otherwise(old)
        return F.struct(more(in_head, acc["head"], acc["head"] + HEAD).alias("head"), more(in_meta, acc["meta"], acc["meta"] + META).alias("meta"), more(in_body, acc["body"], F.least(acc["body"] + x["b"], F.lit(BODY_CAP))).alias("body"))

    points = F.aggregate(counts, start, add)
    base = F.when(first_pattern(url, theme.url_include).isNotNull(), INCLUDED).otherwise(0) if theme.url_include else F.lit(0)
    return F.struct(points["head"].alias("head"), points["meta"].alias("meta"), points["body"].alias("body"), (base + points["head"] + points["meta"] + points["body"]).alias("score"))


def verdict(theme: Theme, hard: Column, score: Column) -> Column:
    return F.when(hard.isNotNull(), "reject").when(score >= theme.min_score, "keep").when(score > 0, "unsure").otherwise("reject")


def combined(policy: str, rules: Column, model: Column, hard: Column) -> Column:
    """Rules and a model's verdict together. decide: the model; tie_break: the model where rules are unsure; agree: keep if both do."""
    has = model.isNotNull() & ~hard
    if policy == "decide":
        out = F.when(has, model)
    elif policy == "tie_break":
        out = F.when(has & (rules == "unsure"), model)
    elif policy == "agree":
        out = F.when(has & (rules == model), rules).when(has, F.lit("unsure"))
    else:
        raise ValueError(f"unknown policy: {policy}")
    return F.coalesce(out, rules)


def accepted(theme: Theme, decision: Column) -> Column:
    return (decision == "keep") | ((decision == "unsure") & F.lit(theme.unsure_action == "keep"))


def hub_verdict(theme: Theme, decision: Column, hub: Column) -> Column:
    """A hub that isn't kept for its text follows the setting for hubs."""
    return F.when(hub & (decision != "keep"), F.lit("keep" if theme.keep_hubs else "reject")).otherwise(decision)


def link_verdict(theme: Theme, url: Column, text: Column) -> Column:
    """skip, hub, fetch or unsure for a link by its URL and text."""
    said = read(theme, normalised(text))
    barred = first_pattern(url, theme.url_exclude).isNotNull()
    for term in theme.exclude_terms:
        barred = barred | (hits(said, term) > 0)
    score = F.when(first_pattern(url, theme.url_include).isNotNull(), INCLUDED).otherwise(0) if theme.url_include else F.lit(0)
    for term in theme.terms:
        score = score + F.when(hits(said, term) > 0, META).otherwise(0)
    hub = first_pattern(url, theme.hub_patterns).isNotNull()
    return F.when(barred, "skip").when(hub, "hub").when(score > 0, "fetch").otherwise("unsure")


def quotes_found(quotes: Column, text: Column) -> Column:
    """The quotes that the text really has."""
    return F.filter(quotes, lambda q: F.contains(normalised(text), normalised(q)))


def explained(decision: Column, score: Column, hard: Column) -> Column:
    """One sentence about a verdict."""
    return F.when(hard.isNotNull(), F.concat(F.lit("Refused by rule "), hard, F.lit("."))).otherwise(F.concat(F.initcap(decision), F.lit(" with score "), score.cast("string"), F.lit(".")))
