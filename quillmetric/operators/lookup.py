"""Filtered, ordered reads and point lookups over keyed tables."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def query_rows(df: DataFrame, at_least: Mapping[str, float] | None = None, like: Mapping[str, str | None] | None = None,
               equals: Mapping[str, object] | None = None, order: Sequence[Column] = (),
               limit: int | None = None) -> DataFrame:
    """Thresholds, case-insensitive substrings and equalities; blank filters and limits below 1 are ignored."""
    for column, floor in (at_least or {}).items():
        df = df.filter(F.col(column) >= floor)
    for column, text in (like or {}).items():
        if text and text.strip():
            df = df.filter(F.contains(F.lower(F.col(column)), F.lit(text.strip().lower())))
    for column, value in (equals or {}).items():
        if value is not None and str(value).strip():
            df = df.filter(F.col(column) == value)
    if order:
        df = df.orderBy(*order)
    return df.limit(int(limit)) if limit and int(limit) > 0 else df


def lookup(requests: DataFrame, rows: DataFrame, key: str, request: str, extracted: Column) -> DataFrame:
    """Rows a request names by id, or by a URL an id can be read from: two equi-joins, no scan per request."""
    asked = requests.select(request, F.explode(F.array_distinct(F.array_compact(
        F.array(F.col(request), extracted)))).alias(key))
    return asked.join(rows, key).dropDuplicates([request, key])
