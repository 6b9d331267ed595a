"""Dates as column expressions, in UTC."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def parse_date(text: Column) -> Column:
    """ISO date, else the first eight characters as yyyymmdd, else null."""
    iso = F.when(F.rlike(text, F.lit(r"^\d{4}-\d{2}-\d{2}")), F.substring(text, 1, 10))
    compact = F.when(F.rlike(text, F.lit(r"^\d{8}")), F.concat_ws("-", F.substring(text, 1, 4), F.substring(text, 5, 2), F.substring(text, 7, 2)))
    return F.coalesce(iso.try_cast("date"), compact.try_cast("date"))


def date_of_epoch(seconds: Column) -> Column:
    return F.date_add(F.lit("1970-01-01").cast("date"), F.floor(seconds / 86400).cast("int"))


def day_count(start: Column, end: Column) -> Column:
    """Days from ``start`` to ``end``, the end excluded."""
    return F.datediff(end, start)


def in_range(day: Column, start, end) -> Column:
    return day.between(start, end)
