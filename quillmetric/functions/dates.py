"""Date column functions. The run date is always a parameter."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column
from pyspark.sql import functions as F

from quillmetric.functions.text import strip, strip_markup

# Words that stand for "no date".
DATE_PLACEHOLDERS = ("", "tbd", "never", "none", "n/a", "na", "-", "--", "?", "not yet")

# The two date notations found in free text.
ISO_DATE = r"\b(\d{4}-\d{2}-\d{2})\b"
WORD_DATE = (r"(?i)\b((?:jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec)[a-z]*)\.?\s+(\d{1,2}),?\s+(\d{4})\b")
ANY_DATE = (r"(?i)\b\d{4}-\d{2}-\d{2}\b|\b(?:jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec)"
            r"[a-z]*\.?\s+\d{1,2},?\s+\d{4}\b")

DAYS_DEFAULT, DAYS_MIN, DAYS_MAX = 7, 1, 90
EPOCH_MILLI_FLOOR = 10_000_000_000


def day(value: dt.date | str | Column) -> Column:
    if isinstance(value, Column):
        return value
    return F.lit(str(value)).cast("date")


def days_before(today, n: int | Column) -> Column:
    return F.date_sub(day(today), n)


def window_days(raw: Column) -> Column:
    """Day count kept in 1..90; anything that is not an integer gives the default."""
    digits = F.regexp_extract(raw, r"^\s*([+-]?)0*(\d+)\s*$", 2)
    # a count of many digits is beyond either limit, whatever its digits
    size = F.when(F.length(digits) > 9, F.lit(DAYS_MAX)).otherwise(digits.try_cast("int"))
    n = F.when(F.ltrim(raw).startswith("-"), F.lit(DAYS_MIN)).otherwise(size)
    # greatest and least skip nulls, so the default comes first
    return F.greatest(F.least(F.coalesce(F.when(digits != "", n), F.lit(DAYS_DEFAULT)), F.lit(DAYS_MAX)), F.lit(DAYS_MIN))


def effective_since(cursor: Column, today, days: Column) -> Column:
    """Later of the stored cursor and the recency limit; a missing cursor is skipped."""
    return F.greatest(cursor, days_before(today, days))


def epoch_to_date(seconds: Column) -> Column:
    return F.to_date(F.timestamp_seconds(seconds.try_cast("bigint")))


def epoch_to_timestamp(value: Column) -> Column:
    """Seconds or milliseconds, told apart by size."""
    return F.when(value > EPOCH_MILLI_FLOOR, F.timestamp_millis(value.cast("bigint"))).otherwise(
        F.timestamp_seconds(value.cast("double")))


def social_date(text: Column) -> Column:
    """'Wed Mar 20 12:34:56 +0000 2026' as a date; the week day is not read."""
    rest = F.regexp_replace(text, r"^[A-Za-z]{3} ", "")
    parts = F.concat_ws(" ", F.regexp_extract(rest, r"^([A-Z][a-z]{2}) +(\d{1,2}) ", 1),
                        F.regexp_extract(rest, r"^([A-Z][a-z]{2}) +(\d{1,2}) ", 2),
                        F.regexp_extract(rest, r" [+-]\d{4} (\d{4})$", 1))
    return F.try_to_date(parts, "MMM d yyyy")


def iso_prefix(text: Column) -> Column:
    return F.try_to_date(F.substring(text, 1, 10), "yyyy-MM-dd")


def connected_on(text: Column) -> Column:
    """'Connected on September 16, 2026' as a date."""
    found = F.regexp_extract(text, r"(?i)connected\s+on\s+([a-z]+\s+\d{1,2},?\s+\d{4})", 1)
    flat = F.initcap(F.regexp_replace(F.replace(found, F.lit(","), F.lit(" ")), r"\s+", " "))
    return F.try_to_date(flat, "MMMM d yyyy")


def _read_date(text: Column) -> Column:
    word = F.initcap(F.substring(F.regexp_extract(text, WORD_DATE, 1), 1, 3))
    worded = F.concat_ws(" ", word, F.regexp_extract(text, WORD_DATE, 2), F.regexp_extract(text, WORD_DATE, 3))
    iso = F.regexp_extract(text, ISO_DATE, 1)
    return F.when(iso != "", F.try_to_date(iso, "yyyy-MM-dd")).otherwise(F.try_to_date(worded, "MMM d yyyy"))


def free_date(text: Column) -> Column:
    """First date in free text; null for placeholder words and for text without a date."""
    body = strip_markup(F.coalesce(text, F.lit("")))
    first = F.regexp_extract(body, "(" + ANY_DATE + ")", 1)
    return F.when(~F.lower(body).isin(*DATE_PLACEHOLDERS), _read_date(first))


def dates_in(text: Column) -> Column:
    """Every date mentioned in the text."""
    found = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit("(" + ANY_DATE + ")"), 1)
    return F.array_compact(F.transform(found, _read_date))


def latest_before(dates: Column, today) -> Column:
    return F.array_max(F.filter(dates, lambda d: d < day(today)))


def unreadable_date(text: Column) -> Column:
    """Text that is no placeholder and still holds no date."""
    body = F.coalesce(text, F.lit(""))
    return ~F.lower(strip(body)).isin(*DATE_PLACEHOLDERS) & free_date(body).isNull()


def business_days_between(start: Column, today) -> Column:
    """Weekdays strictly between two dates: whole weeks, then a bounded remainder."""
    first = F.date_add(start, 1)
    span = F.greatest(F.datediff(day(today), first), F.lit(0))
    weeks, rest = F.floor(span / 7).cast("int"), (span % 7).cast("int")
    begin = F.weekday(first)
    extra = F.lit(0)
    for i in range(6):
        extra = extra + F.when((rest > i) & (((begin + i) % 7) < 5), 1).otherwise(0)
    return F.when(start.isNotNull(), weeks * 5 + extra)


def snowflake_millis(post_id: Column) -> Column:
    return F.shiftright(post_id.try_cast("bigint"), 22)


def snowflake_age_hours(post_id: Column, now_millis: int) -> Column:
    """Hours since the id was issued, at least 0; null (older than everything) for a non-numeric id."""
    hours = (F.lit(now_millis).cast("bigint") - snowflake_millis(post_id)) / F.lit(3600000.0)
    return F.when(hours.isNotNull(), F.greatest(hours, F.lit(0.0)))


def year_text(epoch_millis: Column, header_date: Column) -> Column:
    """Year of the epoch, else of the header date, else 'unknown'."""
    ms = epoch_millis.try_cast("bigint")
    from_epoch = F.when(ms > 0, F.year(F.timestamp_millis(ms)))
    from_header = F.regexp_extract(header_date, r"\b(\d{4})\b", 1)
    return F.coalesce(from_epoch.cast("string"), F.nullif(from_header, F.lit("")), F.lit("unknown"))
