"""Numbers that keep what was written apart from what was read."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_DIGITS = r"\d+(?:_\d+)*"
NUMBER = rf"^\s*[+-]?(?:(?:{_DIGITS}\.?(?:{_DIGITS})?|\.{_DIGITS})(?:[eE][+-]?{_DIGITS})?|(?i:inf|infinity|nan))\s*$"


def number_value(c: Column) -> Column:
    """The double a text stands for; null if it is none.  Digit groups 1_000 count, type suffixes do not."""
    return F.when(c.rlike(NUMBER), F.replace(F.trim(c), F.lit("_"), F.lit("")).try_cast("double"))


def number_status(c: Column) -> Column:
    """null, empty, parsed or invalid."""
    return F.when(c.isNull(), "null").when(F.trim(c) == "", "empty").when(c.rlike(NUMBER), "parsed").otherwise("invalid")


def number_text(c: Column) -> Column:
    """Integral doubles as integers, others as they print."""
    whole = (c == F.floor(c)) & (F.abs(c) < 1e15)
    return F.when(c.isNull() | F.isnan(c), None).when(whole, c.cast("long").cast("string")).otherwise(c.cast("string"))


def values_equal(a: Column, b: Column, eps: float = 1e-9) -> Column:
    """Both empty; or numbers within eps; or the same text whatever its case."""
    x, y = F.trim(F.coalesce(a, F.lit(""))), F.trim(F.coalesce(b, F.lit("")))
    n, m = number_value(x), number_value(y)
    return F.when((x == "") & (y == ""), True).when((x == "") | (y == ""), False).when(n.isNotNull() & m.isNotNull(), F.abs(n - m) <= eps).otherwise(F.lower(x) == F.lower(y))


def ratio(a: Column, b: Column, places: int = 4) -> Column:
    """a / b rounded half-even; 0 where b is 0."""
    return F.when(b == 0, F.lit(0.0)).otherwise(F.bround(a / b, places))
