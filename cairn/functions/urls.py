"""URL functions as column expressions.

They read absolute URLs with regular expressions and never fail: what isn't an
absolute http(s) URL comes back stripped, or as null where a part is asked for.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Query parameters that only track, by the start of their lower-cased name. Fixed values.
TRACKING = ("utm_", "fbclid", "gclid", "mc_cid", "mc_eid", "_ga")
#: Second-level labels that are public under a two-letter country. Fixed values.
SECOND_LEVEL = ("com", "co", "org", "net", "gov", "edu", "ac")

_AUTHORITY = r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)"


def _part(url: Column, pattern: str) -> Column:
    return F.regexp_extract(F.trim(url), pattern, 1)


def scheme(url: Column) -> Column:
    return F.lower(_part(url, r"^([A-Za-z][A-Za-z0-9+.-]*)://"))


def hostport(url: Column) -> Column:
    """The authority without user information, lower-cased."""
    return F.lower(F.regexp_replace(_part(url, _AUTHORITY), r"^.*@", ""))


def host(url: Column) -> Column:
    return F.regexp_replace(hostport(url), r":[0-9]*$", "")


def port(url: Column) -> Column:
    return F.regexp_extract(hostport(url), r":([0-9]+)$", 1).try_cast("int")


def path(url: Column) -> Column:
    found = _part(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)")
    return F.when(found == "", F.lit("/")).otherwise(found)


def query(url: Column) -> Column:
    return _part(url, r"^[^?#]*\?([^#]*)")


def _pairs(text: Column) -> Column:
    """Name-value strings of a query, without empty ones, each with an equals sign, in sorted order."""
    parts = F.filter(F.split(text, "&"), lambda p: p != "")
    return F.array_sort(F.transform(parts, lambda p: F.when(F.contains(p, F.lit("=")), p).otherwise(F.concat(p, F.lit("=")))))


def _with_query(front: Column, pairs: Column) -> Column:
    return F.when(F.size(pairs) > 0, F.concat(front, F.lit("?"), F.array_join(pairs, "&"))).otherwise(front)


def url_key(url: Column) -> Column:
    """One key for URLs of the same page: lower-cased scheme and host, no default port of the scheme, no fragment, no tracking parameters, sorted query."""
    own = F.when((scheme(url) == "http") & (port(url) == 80) | (scheme(url) == "https") & (port(url) == 443) | port(url).isNull(), host(url)).otherwise(hostport(url))
    kept = F.filter(_pairs(query(url)), lambda p: ~F.lower(p).rlike("^(" + "|".join(TRACKING) + ")"))
    whole = _with_query(F.concat(scheme(url), F.lit("://"), own, path(url)), kept)
    return F.when(hostport(url) == "", F.trim(url)).otherwise(whole)


def normalised(url: Column) -> Column:
    """The form in which records are located: http, no www, no ports 80 and 443, no trailing slash, sorted query, no fragment."""
    name = F.regexp_replace(host(url), r"^(www[0-9]*|ww[0-9]?)\.", "")
    own = F.when(port(url).isNull() | port(url).isin(80, 443), name).otherwise(F.concat(name, F.lit(":"), port(url).cast("string")))
    where = F.regexp_replace(path(url), r"(.)/+$", "$1")
    return F.when(hostport(url) == "", F.trim(url)).otherwise(_with_query(F.concat(F.lit("http://"), own, where), _pairs(query(url))))


def without_dots(where: Column) -> Column:
    """A path with its . and .. parts applied; a path that ends in one of them ends in a slash."""
    none = F.array().cast("array<string>")
    step = lambda held, part: F.when(part == "..", F.slice(held, 1, F.greatest(F.size(held) - 1, F.lit(0)))).when(part == ".", held).otherwise(F.concat(held, F.array(part)))
    parts = F.split(F.regexp_replace(where, "^/", ""), "/")
    kept = F.aggregate(parts, none, step)
    whole = F.concat(F.lit("/"), F.array_join(kept, "/"))
    return F.when(where.rlike(r"(?:^|/)\.\.?$") & ~F.endswith(whole, F.lit("/")), F.concat(whole, F.lit("/"))).otherwise(whole)


def resolved(base: Column, link: Column) -> Column:
    """The absolute URL that a link means on a page, its dots applied; null for other schemes than http and https, or without a base."""
    link = F.trim(link)
    front, more = F.regexp_extract(link, r"^([^?#]*)", 1), F.regexp_extract(link, r"^[^?#]*(.*)$", 1)
    root = F.concat(scheme(base), F.lit("://"), hostport(base))
    at = F.regexp_extract(front, r"^((?i:https?:)?//[^/]*)", 1)
    there = F.when(F.startswith(at, F.lit("//")), F.concat(scheme(base), F.lit(":"), at)).otherwise(F.concat(F.lower(F.substring_index(at, ":", 1)), F.regexp_extract(at, "^[^:]*(.*)$", 1)))
    onward = F.regexp_replace(front, r"^(?i:https?:)?//[^/]*", "")
    beside = F.concat(F.regexp_replace(path(base), "[^/]*$", ""), front)
    own = F.concat(root, path(base))
    asked = F.when(query(base) == "", own).otherwise(F.concat(own, F.lit("?"), query(base)))
    return (
        F.when(hostport(base) == "", F.lit(None))
        .when(at != "", F.concat(there, without_dots(onward), more))
        .when(front.rlike("^[A-Za-z][A-Za-z0-9+.-]*:"), F.lit(None))
        .when(F.startswith(front, F.lit("/")), F.concat(root, without_dots(front), more))
        .when(front != "", F.concat(root, without_dots(beside), more))
        .when(F.startswith(more, F.lit("?")), F.concat(own, more))
        .otherwise(F.concat(asked, more))
    )


def _bytes_escaped(char: Column) -> Column:
    return F.lower(F.regexp_replace(F.hex(F.encode(char, "UTF-8")), "(..)", "%$1"))


def _escaped(text: Column, space: str, high_order: bool, low_order: bool) -> Column:
    """Each part of a text in its one form: escapes, stray percent signs, and what stands between them."""
    tokens = F.regexp_extract_all(text, F.lit(r"(%[cCdD][0-9a-fA-F]%[89abAB][0-9a-fA-F]|%[0-9a-fA-F]{2}|%|[^%]+)"), 1)
    beyond = "[\\x{800}-\\x{10FFFF}]" if high_order else "[^\\x00-\\x7F]"

    def plain(t: Column) -> Column:
        t = F.replace(F.replace(t, F.lit(" "), F.lit(space)), F.lit("\\"), F.lit("%5c"))
        each = F.array_join(F.transform(F.split(t, ""), lambda c: F.when(c.rlike(beyond), _bytes_escaped(c)).otherwise(c)), "")
        return F.when(t.rlike(beyond), each).otherwise(t)

    def one(t: Column) -> Column:
        code = F.conv(F.substring(t, 2, 2), 16, 10).cast("int")
        kept = F.lower(t)
        two = F.decode(F.unhex(F.concat(F.substring(t, 2, 2), F.substring(t, 5, 2))), "UTF-8")
        low = F.when(code == 32, F.lit(space)).when((code < 33) | (code > 126) | F.char(code).isin("%", "\\", "#"), kept).otherwise(F.char(code) if low_order else kept)
        return F.when(F.length(t) == 6, two if high_order else kept).when(F.length(t) == 3, low).otherwise(F.lit("%25"))

    return F.array_join(F.transform(tokens, lambda t: F.when(F.startswith(t, F.lit("%")), one(t)).otherwise(plain(t))), "")


def escaped(url: Column, high_order: bool = True, low_order: bool = True) -> Column:
    """A URL with percent-encoding in one form.

    Percent signs that escape nothing are escaped themselves, and escapes of
    printable ASCII are undone but for space, percent, backslash and hash;
    hexadecimal digits are lower-case. A space becomes %20, and + behind the
    question mark. Characters of two bytes stand for themselves with high_order,
    longer ones are escaped. low_order: whether escapes of ASCII are undone.
    """
    front, more = F.regexp_extract(url, r"(?s)^([^?]*)", 1), F.regexp_extract(url, r"(?s)^[^?]*(.*)$", 1)
    return F.concat(_escaped(front, "%20", high_order, low_order), _escaped(more, "+", high_order, low_order))


def canonical(url: Column, high_order: bool = True) -> Column:
    """normalised() with percent-encoding in one form and without slashes at the end, unless there is a host only."""
    bare = F.regexp_replace(escaped(normalised(url), high_order), "/+$", "")
    return F.when(bare.rlike("^https?://[^/]+$"), F.concat(bare, F.lit("/"))).otherwise(bare)


@F.pandas_udf(T.StringType())
def ascii_host(names: pd.Series) -> pd.Series:
    """Hosts in the form that name servers know: lower-cased, other alphabets as xn--...; null for what isn't a host's name."""

    def one(name: str | None) -> str | None:
        try:
            return None if name is None else name.strip().rstrip(".").encode("idna").decode().lower()
        except UnicodeError:
            return None

    return names.map(one)


def replay_key(url: Column) -> Column:
    """(host without www., path, query)."""
    return F.struct(F.regexp_replace(host(url), r"^www\.", "").alias("host"), path(url).alias("path"), query(url).alias("query"))


def cli_key(url: Column) -> Column:
    """(scheme, host and port, path, query)."""
    return F.struct(scheme(url).alias("scheme"), hostport(url).alias("host"), path(url).alias("path"), query(url).alias("query"))


def toggled_www(name: Column) -> Column:
    return F.when(F.startswith(name, F.lit("www.")), F.substr(name, F.lit(5))).otherwise(F.concat(F.lit("www."), name))


def registrable(name: Column) -> Column:
    """The domain of a host: its last two labels, or three under a known second level of a country."""
    labels = F.split(name, r"\.")
    n = F.size(labels)
    three = (F.length(F.get(labels, n - 1)) == 2) & F.get(labels, n - 2).isin(*SECOND_LEVEL)
    take = lambda k: F.array_join(F.slice(labels, n - k + 1, F.lit(k)), ".")
    return F.when(n <= 2, name).when(three, take(3)).otherwise(take(2))


def with_suffixes(df: DataFrame, name: str, rules: DataFrame) -> DataFrame:
    """df with public_suffix and private_suffix of the hosts in column name.

    rules (rule) are lines of a public suffix list: a suffix, one with * for a
    label, or one after ! that is an exception to those. The longest rule counts,
    an exception before all others, and its suffix is without its first label; a
    host that no rule fits has its last label as suffix. The private suffix has
    one label more; a host that is a public suffix, or no name at all, stands for
    itself. Each host of df is looked up once, by a join of its endings with the rules.
    """
    hosts = df.select(F.col(name).alias("_host")).where(F.col(name).rlike(r"^[^.\s/:]+(?:\.[^.\s/:]+)*$") & ~F.col(name).rlike(r"^[0-9.]+$")).distinct()
    labels = hosts.select("_host", F.split(F.lower("_host"), r"\.").alias("_l"))
    ends = labels.select("_host", "_l", F.explode(F.sequence(F.lit(1), F.size("_l"))).alias("_n"))
    tail = lambda n: F.array_join(F.slice("_l", F.size("_l") - n + 1, n), ".")
    forms = F.array(F.struct(tail(F.col("_n")).alias("rule")), F.struct(F.when(F.col("_n") > 1, F.concat(F.lit("*."), tail(F.col("_n") - 1))).alias("rule")), F.struct(F.concat(F.lit("!"), tail(F.col("_n"))).alias("rule")))
    met = ends.select("_host", "_n", F.inline(forms)).join(rules.select(F.lower(F.trim("rule")).alias("rule")).distinct(), "rule")
    spared = F.startswith("rule", F.lit("!"))
    best = met.groupBy("_host").agg(F.max(F.struct(spared.alias("spared"), F.when(spared, F.col("_n") - 1).otherwise(F.col("_n")).alias("n"))).alias("b"))
    found = labels.join(best, "_host", "left").withColumn("n", F.coalesce("b.n", F.lit(1)))
    found = found.select(F.col("_host").alias(name), tail(F.col("n")).alias("public_suffix"), tail(F.least(F.col("n") + 1, F.size("_l"))).alias("private_suffix"))
    return df.join(found, name, "left").withColumn("private_suffix", F.coalesce("private_suffix", name))


def last_two_labels(name: Column) -> Column:
    return F.substring_index(name, ".", -2)


def host_levels(name: Column) -> Column:
    """SURT forms of a host's suffixes, the shortest first: (com,  (com,example,  ..."""
    back = F.reverse(F.split(name, r"\."))
    return F.transform(F.sequence(F.lit(1), F.size(back)), lambda k: F.concat(F.lit("("), F.array_join(F.slice(back, F.lit(1), k), ","), F.lit(",")))


def url_type(url: Column) -> Column:
    """slashpage, robots or normal."""
    where = F.lower(path(url))
    return F.when(where.rlike(r"^/?$|^/index\.[a-z]+$"), "slashpage").when(where == "/robots.txt", "robots").otherwise("normal")


def resource_name(url: Column) -> Column:
    """What follows the last slash of the path, up to ? or &."""
    return F.regexp_extract(path(url), r"([^/?&]*)(?:&.*)?$", 1)


def extension(url: Column) -> Column:
    """The resource's extension in lower case with letters and digits only, or empty."""
    return F.regexp_replace(F.lower(F.regexp_extract(resource_name(url), r"\.([^.]*)$", 1)), "[^0-9a-z]", "")


def header_value(value: Column) -> Column:
    """A header's URI without angle brackets."""
    return F.regexp_replace(value, "^<|>$", "")


def seed_prefix(url: str) -> str:
    """The prefix of a seed's own directory: the seed itself unless its last segment has a dot."""
    if url.endswith("/"):
        return url
    front, last = url.rsplit("/", 1)
    return front + "/" if "." in last else url + "/"


def in_scope(url: Column, seed: str, strategy: str = "same-host", include: tuple[str, ...] = (), exclude: tuple[str, ...] = ()) -> Column:
    """Whether a URL is in a seed's scope. strategy: same-host, same-domain, path-prefix or any."""
    own = F.lit(seed)
    tests = {"same-host": host(url) == host(own), "same-domain": registrable(host(url)) == registrable(host(own)), "path-prefix": F.startswith(url, F.lit(seed_prefix(seed))) | (url == seed), "any": F.lit(True)}
    if strategy not in tests:
        raise ValueError(f"unknown scope strategy: {strategy}")
    ok = tests[strategy]
    if include:
        ok = ok & url.rlike("|".join(f"(?:{p})" for p in include))
    if exclude:
        ok = ok & ~url.rlike("|".join(f"(?:{p})" for p in exclude))
    return ok


def document_id(url: Column, day: Column) -> Column:
    """Wayback date, a slash, and the URL's md5 in base64."""
    return F.concat(F.regexp_replace(day, "[^0-9]", ""), F.lit("/"), F.base64(F.unhex(F.md5(url))))


def safe_filename(name: Column, longest: int = 120) -> Column:
    clean = F.regexp_replace(F.regexp_replace(name, r'[<>:"/\\|?*\x00-\x1f\s]+', "-"), "-{2,}", "-")
    clean = F.substring(F.regexp_replace(clean, r"^[-. ]+|[-. ]+$", ""), 1, longest)
    return F.when(clean == "", "unnamed").otherwise(clean)


def slug(name: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(name), "[^a-z0-9]+", "-"), "^-|-$", "")
