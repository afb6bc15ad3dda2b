"""Number, score-text, salary and colour column functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quillmetric.functions.text import strip

# Currency signs and interval words of salary text.
CURRENCIES = {"$": "USD", "€": "EUR", "£": "GBP"}
INTERVALS = {
    "yr": "yearly", "year": "yearly", "mo": "monthly", "month": "monthly",
    "wk": "weekly", "week": "weekly", "day": "daily", "hr": "hourly", "hour": "hourly",
}

# Label vocabularies of job and company records, tested in this order.
WORKPLACES = {"remote": "remote", "hybrid": "hybrid", "on-site": "onSite", "onsite": "onSite", "on site": "onSite"}
EMPLOYMENTS = {
    "full-time": "fullTime", "full time": "fullTime", "fulltime": "fullTime",
    "part-time": "partTime", "part time": "partTime", "parttime": "partTime",
    "contract": "contract", "temporary": "temporary", "volunteer": "volunteer",
    "internship": "internship", "other": "other",
}
EXPERIENCES = {
    "internship": "internship", "entry level": "entryLevel", "entry-level": "entryLevel",
    "associate": "associate", "mid-senior level": "midSeniorLevel",
    "mid senior level": "midSeniorLevel", "director": "director", "executive": "executive",
}
COMPANY_SIZES = ("1-10", "11-50", "51-200", "201-500", "501-1000", "1001-5000", "5001-10000", "10001+")

# The amount range of a salary text.
SALARY_RANGE = (
    r"(?i)([$€£])?\s*([\d,.]+)\s*([km])?\s*(?:-|–|—|to)\s*([$€£])?\s*([\d,.]+)\s*([km])?"
)


def count_or_zero(value: Column) -> Column:
    """Whole part of a number; null, junk and what no long holds are 0."""
    number = F.regexp_extract(value.cast("string"), r"^\s*([+-]?\d+(?:\.\d*)?)\s*$", 1)
    whole = F.regexp_extract(number, r"^[+-]?\d+", 0)
    return F.coalesce(whole.try_cast("decimal(38,0)").try_cast("bigint"), F.lit(0).cast("bigint"))


def _magnitude(suffix: Column) -> Column:
    return (F.when(F.upper(suffix) == "K", F.lit(1e3)).when(F.upper(suffix) == "M", F.lit(1e6)).otherwise(F.lit(1.0)))


def compact_number(text: Column) -> Column:
    """'45,231', '1.2M' or '3K' as an integer; null where no number can be read."""
    flat = F.replace(strip(text), F.lit(","), F.lit(""))
    pattern = r"([\d.]+)\s*([KkMm])?\+?"
    number = F.regexp_extract(flat, pattern, 1).try_cast("double")
    return F.bround(number * _magnitude(F.regexp_extract(flat, pattern, 2)), 0).cast("bigint")


def score_text(text: Column) -> Column:
    """Stated midpoint, else the mean of the first two numbers, else the only number."""
    body = F.coalesce(text, F.lit(""))
    midpoint = F.regexp_extract(body, r"(?i)midpoint\s+(\d+(?:\.\d+)?)", 1)
    numbers = F.transform(
        F.slice(F.regexp_extract_all(body, F.lit(r"\d+(?:\.\d+)?"), 0), 1, 2), lambda n: n.cast("double"))
    total = F.aggregate(numbers, F.lit(0.0), lambda a, n: a + n)
    return (F.when(midpoint != "", midpoint.try_cast("double"))
            .when(F.size(numbers) > 0, total / F.size(numbers)))


def first_label(text: Column, labels: dict[str, str]) -> Column:
    """Value of the first label contained in the squeezed lower-case text."""
    low = F.lower(F.regexp_replace(strip(text), r"(?U)\s+", " "))
    out = F.lit(None).cast("string")
    for key in reversed(list(labels)):
        out = F.when(F.contains(low, F.lit(key)), F.lit(labels[key])).otherwise(out)
    return F.when(low == "", None).otherwise(out)


def company_size(text: Column) -> Column:
    """Size bracket of 'N-M employees'; text without a known bracket is Unknown."""
    low = strip(F.regexp_replace(F.replace(F.lower(text), F.lit(","), F.lit("")), "employees?", ""))
    packed = F.translate(low, "- ", "")
    ranged = F.concat_ws("-", F.regexp_extract(low, r"(\d+)\s*-\s*(\d+)", 1),
                         F.regexp_extract(low, r"(\d+)\s*-\s*(\d+)", 2))
    out = (F.when(ranged.isin(*COMPANY_SIZES), ranged)
           .when(F.regexp_extract(low, r"(\d+)\s*\+", 1) == "10001", F.lit("10001+"))
           .when(low != "", F.lit("Unknown")))
    for bracket in reversed(COMPANY_SIZES):
        out = F.when(F.contains(packed, F.lit(bracket.replace("-", ""))), F.lit(bracket)).otherwise(out)
    return F.when(F.length(text) > 0, out)


def _interval(low: Column, lead: str) -> Column:
    out = F.lit(None).cast("string")
    for word in reversed(list(INTERVALS)):
        out = F.when(low.rlike(lead + word + r"\b"), F.lit(INTERVALS[word])).otherwise(out)
    return out


def salary_range(text: Column) -> Column:
    """struct(min, max, currency, interval); all null where no range can be read."""
    low = F.lower(text)
    cleaned = F.regexp_replace(text, r"(?i)/\s*(?:yr|year|hr|hour|mo|month|wk|week|day)s?\b", "")

    def group(i: int) -> Column:
        return F.regexp_extract(cleaned, SALARY_RANGE, i)

    def amount(number: Column, suffix: Column) -> Column:
        return F.replace(number, F.lit(","), F.lit("")).try_cast("double") * _magnitude(suffix)

    sign = F.coalesce(F.nullif(group(1), F.lit("")), F.nullif(group(4), F.lit("")))
    currency = F.lit(None).cast("string")
    for mark, code in CURRENCIES.items():
        currency = F.when(sign == mark, F.lit(code)).otherwise(currency)
    interval = F.coalesce(_interval(low, r"/\s*"), _interval(low, r"\b"))
    # one unreadable amount makes the whole text unreadable
    low_end, high_end = amount(group(2), group(3)), amount(group(5), group(6))
    found = low_end.isNotNull() & high_end.isNotNull()
    return F.struct(
        F.when(found, low_end).alias("salary_min"),
        F.when(found, high_end).alias("salary_max"),
        F.when(found, currency).alias("currency"),
        F.when(found, interval).alias("interval"),
    )


def _channel(value: Column) -> Column:
    scaled = value / F.lit(255.0)
    return F.when(scaled <= 0.03928, scaled / 12.92).otherwise(F.pow((scaled + 0.055) / 1.055, F.lit(2.4)))


def _rgb_part(colour: Column, i: int) -> Column:
    inner = F.regexp_extract(colour, r"rgba?\(([^)]+)\)", 1)
    return F.get(F.split(inner, ","), F.lit(i)).try_cast("double")


def luminance(colour: Column) -> Column:
    r, g, b = (_channel(_rgb_part(colour, i)) for i in range(3))
    return F.lit(0.2126) * r + F.lit(0.7152) * g + F.lit(0.0722) * b


def contrast(fore: Column, back: Column) -> Column:
    """Contrast ratio of two rgb() texts; 1 for an unreadable colour or a fully transparent front."""
    a, b = luminance(fore), luminance(back)
    ratio = (F.greatest(a, b) + 0.05) / (F.least(a, b) + 0.05)
    clear = F.coalesce(_rgb_part(fore, 3), F.lit(1.0)) == 0
    return F.when(a.isNull() | b.isNull() | clear, F.lit(1.0)).otherwise(ratio)
