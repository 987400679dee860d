"""Dates with a status: a year alone is partial, not the first of January."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

ISO = r"^\d{4}-\d{2}-\d{2}$"


def date_value(c: Column) -> Column:
    return F.when(c.rlike(ISO), c.try_cast("date"))


def date_status(c: Column) -> Column:
    """null, empty, parsed, partial or invalid."""
    return F.when(c.isNull(), "null").when(F.trim(c) == "", "empty").when(date_value(c).isNotNull(), "parsed").when(F.trim(c).rlike(r"^\d{4}$"), "partial").otherwise("invalid")


def any_date(c: Column) -> Column:
    """The first of several layouts that fits."""
    cut = F.trim(c)
    layouts = [(r"^\d{4}-\d{1,2}-\d{1,2}[T ]\d{1,2}:\d{1,2}:\d{1,2}", r"^(\d{4}-\d{1,2}-\d{1,2}).*$", "yyyy-M-d"), (r"^\d{4}-\d{1,2}-\d{1,2}$", r"^(.*)$", "yyyy-M-d"), (r"^\d{1,2}/\d{1,2}/\d{4}$", r"^(.*)$", "M/d/yyyy"), (r"^\d{4}/\d{1,2}/\d{1,2}$", r"^(.*)$", "yyyy/M/d"), (r"^\d{8}$", r"^(.*)$", "yyyyMMdd")]
    return F.coalesce(*[F.when(cut.rlike(test), F.try_to_timestamp(F.regexp_extract(cut, part, 1), F.lit(fmt)).cast("date")) for test, part, fmt in layouts])


def in_scope(date: Column, status: Column, least: str = "2011-01-01") -> Column:
    return F.coalesce(date.isNotNull() & (status == "parsed") & (date >= F.lit(least).cast("date")), F.lit(False))


def iso_text_in_scope(c: Column, least: str = "2011-01-01") -> Column:
    """Whether an ISO date kept as text is not before `least`; such texts order as the dates do.  Null is not in scope."""
    return F.coalesce(c >= F.lit(least), F.lit(False))
