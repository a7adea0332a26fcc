"""Text, number and digest functions as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SPACES = r"(?U)\s+"


def collapsed(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def first_line(text: Column, longest: int = 120) -> Column:
    """The first line with anything on it, cut with an ellipsis."""
    line = F.trim(F.regexp_extract(text, r"^\s*([^\n]*)", 1))
    return F.when(F.length(line) > longest, F.concat(F.rtrim(F.substring(line, 1, longest - 1)), F.lit("…"))).otherwise(line)


def parse_count(text: Column) -> Column:
    """Counts like 1,234 or 1.2K or 3M; null for what isn't one."""
    clean = F.upper(F.regexp_replace(F.trim(text), "[, ]", ""))
    number = F.regexp_extract(clean, r"^([0-9]+(?:\.[0-9]+)?)([KMB]?)$", 1).try_cast("decimal(20,6)")
    unit = F.regexp_extract(clean, r"^([0-9]+(?:\.[0-9]+)?)([KMB]?)$", 2)
    factor = F.when(unit == "K", 1_000).when(unit == "M", 1_000_000).when(unit == "B", 1_000_000_000).otherwise(1)
    return F.floor(number * factor).cast("long")


def sha1_digest(data: Column) -> Column:
    return F.concat(F.lit("sha1:"), F.sha1(data))


def base32(hex_text: Column) -> Column:
    """Hexadecimal digits as base32: bits are taken five at a time."""
    bits = F.array_join(F.transform(F.split(hex_text, ""), lambda d: F.lpad(F.conv(d, 16, 2), 4, "0")), "")
    groups = F.transform(F.sequence(F.lit(1), F.ceil(F.length(bits) / 5).cast("int")), lambda k: F.rpad(F.substr(bits, (k - 1) * 5 + 1, F.lit(5)), 5, "0"))
    letters = F.split(F.lit("ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"), "")
    return F.array_join(F.transform(groups, lambda g: F.get(letters, F.conv(g, 2, 10).cast("int"))), "")


def first_bytes(data: Column, n: int = 32) -> Column:
    """The first bytes in hexadecimal, a space between them; null for fewer than four."""
    hex_text = F.lower(F.hex(F.substring(data.cast("binary"), 1, n)))
    return F.when(F.length(hex_text) >= 8, F.rtrim(F.regexp_replace(hex_text, "(..)", "$1 ")))


def byte_shingles(spaced: Column, least: int = 4, most: int = 7) -> Column:
    """All runs of least to most neighbouring tokens."""
    tokens = F.split(spaced, " ")
    runs = lambda k: F.when(F.size(tokens) >= k, F.transform(F.sequence(F.lit(1), F.size(tokens) - k + 1), lambda i: F.array_join(F.slice(tokens, i, F.lit(k)), " "))).otherwise(F.array().cast("array<string>"))
    return F.flatten(F.array(*[runs(k) for k in range(least, most + 1)]))


def human_bytes(size: Column) -> Column:
    """A size in B, KB, MB, GB or TB with one decimal."""
    out, factor = F.concat(F.format_number(size / 1024**4, 1), F.lit(" TB")), 1024**3
    for unit in ("GB", "MB", "KB"):
        out = F.when(size < factor * 1024, F.concat(F.format_number(size / factor, 1), F.lit(f" {unit}"))).otherwise(out)
        factor //= 1024
    return F.when(size < 1024, F.concat(size.cast("string"), F.lit(" B"))).otherwise(out)


def sentence(text: Column) -> Column:
    return F.concat(F.upper(F.substring(text, 1, 1)), F.substr(text, F.lit(2)))


def degrees(text: Column, limit: int) -> Column:
    """Degrees, minutes and seconds with a hemisphere as decimal degrees; null out of range."""
    part = lambda k: F.regexp_extract(text, r"^([0-9.]+)°(?:([0-9.]+)')?(?:([0-9.]+)\")?([NSEW])$", k)
    value = part(1).try_cast("double") + F.coalesce(part(2).try_cast("double"), F.lit(0.0)) / 60 + F.coalesce(part(3).try_cast("double"), F.lit(0.0)) / 3600
    signed = F.when(part(4).isin("S", "W"), -value).otherwise(value)
    return F.when(F.abs(signed) <= limit, signed)


def bucket_of(score: Column, n: int = 5) -> Column:
    """A sentiment score's bucket: its sign times the logarithm of its size, shifted to 0 .. n - 1."""
    x = F.signum(score) * F.log1p(F.abs(score)) / F.lit(2.0)
    return F.greatest(F.lit(0), F.least(F.lit(n - 1), F.floor(x + n / 2.0))).cast("int")


def charset(content_type: Column) -> Column:
    return F.nullif(F.lower(F.regexp_extract(content_type, r"(?i)charset=\"?([A-Za-z0-9_.\-]+)", 1)), F.lit(""))


def first_id(text: Column) -> Column:
    """The first run of six digits or more."""
    return F.nullif(F.regexp_extract(text, "([0-9]{6,})", 1), F.lit(""))


def aliases(*ids: Column, url: Column) -> Column:
    """Distinct ids of a post: those given, and long digit runs in its URL's path."""
    return F.array_distinct(F.array_compact(F.concat(F.array(*ids), F.regexp_extract_all(url, F.lit("/([0-9]{8,})"), 1))))


def comment_parts(comment: Column) -> Column:
    """(parent, reply) of ids like parent.reply; reply is null for a comment of its own."""
    return F.struct(F.split_part(comment, F.lit("."), F.lit(1)).alias("parent"), F.nullif(F.split_part(comment, F.lit("."), F.lit(2)), F.lit("")).alias("reply"))


def kv(name: str, value: Column) -> Column:
    """name=value, or null for an empty value."""
    text = value.cast("string")
    return F.when(text.isNotNull() & (text != ""), F.concat(F.lit(name + "="), text))


def adjusted(text: Column, rewrites: tuple[tuple[str, str], ...] = (), longest: int | None = None) -> Column:
    """Control characters to spaces, white space collapsed, rewrites in order, cut, and null if nothing is left."""
    out = collapsed(F.regexp_replace(text, r"[\x00-\x1f\x7f]", " "))
    for pattern, by in rewrites:
        out = F.regexp_replace(out, pattern, by)
    if longest:
        out = F.substring(out, 1, longest)
    return F.nullif(out, F.lit(""))


def widest(items: Column) -> Column:
    """Of structs with width the first of the widest."""
    return F.aggregate(items, F.get(items, F.lit(0)), lambda best, x: F.when(x["width"] > best["width"], x).otherwise(best))
