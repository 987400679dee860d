"""Lenient readings of stored text: JSON lists, metrics, floats."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

WHOLE = r"^\s*[+-]?\d+\s*$"
NUMBER = r"(?i)^\s*[+-]?(\d+\.?\d*(e[+-]?\d+)?|\.\d+(e[+-]?\d+)?|inf(inity)?|nan)\s*$"


def json_list(c: Column) -> Column:
    """Elements of a JSON array as texts; null, invalid JSON and other JSON give an empty list."""
    return F.coalesce(F.from_json(c, "array<string>"), F.array().cast("array<string>"))


def float_value(c: Column) -> Column:
    """A number written in text, else null."""
    return F.when(c.rlike(NUMBER), F.trim(c).try_cast("double"))


def metric(c: Column) -> Column:
    """A struct in which one field at most is set: whole (long), number (double) or raw (the text as it is)."""
    whole = F.when(c.rlike(WHOLE), F.trim(c).try_cast("long"))
    number = F.when(whole.isNull(), float_value(c))
    return F.struct(whole.alias("whole"), number.alias("number"), F.when(whole.isNull() & number.isNull(), c).alias("raw"))
