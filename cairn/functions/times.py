"""Dates of many forms as column expressions; what is no date is null, never an error."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Seconds of a unit of relative time; months and years are whole days. Fixed values.
UNIT_SECONDS = {"second": 1, "minute": 60, "hour": 3600, "day": 86400, "week": 604800, "month": 2592000, "year": 31536000}
#: Milliseconds at which time-ordered post ids begin. Fixed value.
SNOWFLAKE_EPOCH_MS = 1288834974657
#: Month names that dates are read by. Fixed values.
MONTHS = ("Jan", "Feb", "Mar", "Apr", "May", "Jun", "Jul", "Aug", "Sep", "Oct", "Nov", "Dec")


def _try(text: Column, pattern: str) -> Column:
    return F.try_to_timestamp(text, F.lit(pattern))


def parse_time(value: Column) -> Column:
    """A timestamp of 14 digits, 9 to 11 digits of epoch seconds, 8 digits of a day, or ISO 8601; without a zone it is UTC."""
    text = F.trim(value)
    iso = F.regexp_replace(text, "Z$", "+00:00").try_cast("timestamp")
    return (
        F.when(text.rlike("^[0-9]{14}$"), _try(text, "yyyyMMddHHmmss"))
        .when(text.rlike("^[0-9]{9,11}$"), F.timestamp_seconds(text.try_cast("long")))
        .when(text.rlike("^[0-9]{8}$"), _try(text, "yyyyMMdd"))
        .when(text.rlike(r"^[0-9]{4}-[0-9]{2}-[0-9]{2}"), iso)
    )


def from_epoch(value: Column) -> Column:
    """Epoch seconds, or milliseconds from ten thousand million on."""
    return F.timestamp_millis(F.when(F.abs(value) >= 10_000_000_000, value).otherwise(value * 1000).cast("long"))


def iso_utc(when: Column) -> Column:
    return F.date_format(when, "yyyy-MM-dd'T'HH:mm:ss'Z'")


def wayback(when: Column) -> Column:
    return F.date_format(when, "yyyyMMddHHmmss").cast("long")


def wayback_of(digits: Column) -> Column:
    """A timestamp of 12, 14, 16 or more digits: seconds are filled up or what follows them is cut."""
    return F.when(digits.rlike("^[0-9]{12,}$"), _try(F.substring(F.rpad(digits, 14, "0"), 1, 14), "yyyyMMddHHmmss"))


def year_of(text: Column) -> Column:
    """The first four digits, or unknown."""
    found = F.regexp_extract(text, "^([0-9]{4})", 1)
    return F.when((found == "") | (found == "0000"), "unknown").otherwise(found)


def snowflake(post_id: Column) -> Column:
    return F.timestamp_millis(F.shiftright(post_id, 22) + SNOWFLAKE_EPOCH_MS)


def relative(text: Column, now: Column) -> Column:
    """The time that many units before now, for texts like '3 days ago'."""
    n, unit = F.regexp_extract(text, "([0-9]+) *([a-z]+?)s? ago", 1).try_cast("long"), F.regexp_extract(text, "([0-9]+) *([a-z]+?)s? ago", 2)
    seconds = F.lit(None).cast("long")
    for name, size in UNIT_SECONDS.items():
        seconds = F.when(unit == name, F.lit(size)).otherwise(seconds)
    return F.timestamp_seconds(F.unix_timestamp(now) - n * seconds)


def weekday_time(text: Column) -> Column:
    """Times like 'Wed Oct 10 20:19:24 +0000 2018'."""
    part = lambda k: F.regexp_extract(text, r"^[A-Z][a-z]{2} ([A-Z][a-z]{2}) ([0-9]{2}) ([0-9:]{8}) ([+-][0-9]{4}) ([0-9]{4})$", k)
    month = F.lpad(F.array_position(F.array(*map(F.lit, MONTHS)), part(1)).cast("string"), 2, "0")
    return F.when(part(5) != "", F.concat(part(5), F.lit("-"), month, F.lit("-"), part(2), F.lit("T"), part(3), F.regexp_replace(part(4), "([0-9]{2})$", ":$1")).try_cast("timestamp"))


def loose_date(text: Column) -> Column:
    """The first date in a text: day/month/year, else month/day/year, else year-month-day."""
    european = F.regexp_extract(text, r"\b([0-3]?[0-9][./][01]?[0-9][./][0-9]{4})\b", 1)
    american = F.regexp_extract(text, r"\b([01]?[0-9][./][0-3]?[0-9][./][0-9]{4})\b", 1)
    technical = F.regexp_extract(text, r"\b([0-9]{4}-[01][0-9]-[0-3][0-9])\b", 1)
    slashed = lambda c: F.regexp_replace(c, "[.]", "/")
    return F.coalesce(F.to_date(_try(slashed(european), "d/M/yyyy")), F.to_date(_try(slashed(american), "M/d/yyyy")), F.to_date(_try(technical, "yyyy-MM-dd")))


def day_bounds(first: str | None, last: str | None) -> tuple[str | None, str | None]:
    """Inclusive bounds of days as UTC texts; they must be in order."""
    if first and last and first > last:
        raise ValueError("the first day is after the last")
    return (f"{first}T00:00:00Z" if first else None, f"{last}T23:59:59Z" if last else None)
