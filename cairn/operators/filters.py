"""Which records go on: types, protocols, statuses, patterns, and a capture's first page."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def of_types(kind: Column, types: tuple[str, ...]) -> Column:
    """Whether a record's type is listed; an empty list takes all."""
    return kind.isin(*types) if types else F.lit(True)


def of_protocols(url: Column, prefixes: tuple[str, ...]) -> Column:
    out = F.lit(not prefixes)
    for p in prefixes:
        out = out | F.startswith(url, F.lit(p))
    return out


def of_statuses(status: Column, prefixes: tuple[str, ...]) -> Column:
    """Whether a status begins with a listed text: '2' is any 2xx. No status is refused if there is a list."""
    if not prefixes:
        return F.lit(True)
    out = F.lit(False)
    for p in prefixes:
        out = out | F.startswith(status.cast("string"), F.lit(p))
    return F.coalesce(out, F.lit(False))


def not_excluded(url: Column, patterns: tuple[str, ...]) -> Column:
    return ~url.rlike("|".join(f"(?:{p})" for p in patterns)) if patterns else F.lit(True)


def grep(uri: Column, text: str) -> Column:
    """Whether a URI has a text, whatever the case."""
    return F.contains(F.lower(uri), F.lit(text.lower()))


def start_urls(rows: DataFrame, key: str, order: list[str], url: str, status: str, mime: str, length: str) -> DataFrame:
    """(key, start): the first page of each capture that was found and isn't empty."""
    ok = (F.col(status) == 200) & F.contains(F.lower(F.col(mime)), F.lit("html")) & (F.col(length) > 0)
    return rows.where(ok).groupBy(key).agg(F.min_by(url, F.struct(*order)).alias("start"))


def challenge(html: Column, markers: tuple[str, ...]) -> Column:
    """Whether a short page is a challenge: a marker near its top."""
    top = F.lower(F.substring(html, 1, 8000))
    hit = F.lit(False)
    for m in markers:
        hit = hit | F.contains(top, F.lit(m))
    return (F.length(html) <= 30_000) & hit


def suspect(marked: Column, status: Column, kind: Column) -> Column:
    """What is wrong with a page's part: challenged, or failed for the page's own calls."""
    return F.when(marked, "waf-challenged").when((status >= 400) & kind.isin("xhr", "fetch"), "subresource-error")


def near_hashes(rows: DataFrame, bits: Column, key: str, bands: int, width: int) -> DataFrame:
    """(a, b) of rows that share a band of their bit text, each with its band's smallest row: links, not all pairs."""
    parts = F.posexplode(F.transform(F.sequence(F.lit(0), F.lit(bands - 1)), lambda k: F.substr(bits, k * width + 1, F.lit(width))))
    banded = rows.select(key, parts.alias("band", "value"))
    lead = banded.groupBy("band", "value").agg(F.min(key).alias("a"), F.count("*").alias("n")).where("n > 1")
    return banded.join(lead, ["band", "value"]).where(F.col(key) > F.col("a")).select("a", F.col(key).alias("b")).distinct()


def sentiment(text: Column, good: tuple[str, ...], bad: tuple[str, ...]) -> Column:
    """Good words less bad words of a text."""
    words = F.split(F.lower(text), r"[^\p{L}]+")
    count = lambda which: F.size(F.filter(words, lambda w: w.isin(*which)))
    return count(good) - count(bad)
