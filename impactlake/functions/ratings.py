"""Values of an external ratings table: placeholders, and which values may overwrite ours."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .numbers import number_value

NOT_RATED = "Not Rated"
# fixed values: spellings as they occur in the external table
BLANKS = ["", "N/A", "NA", "TBD", "UNKNOWN"]
FEATURE_STATUSES = ["STANDARD", "OPTIONAL", "NOT AVAILABLE", "NOT AVALIABLE", "MEETS CRITERIA", "DOES NOT MEET CRITERIA", "YES"]


def clean(c: Column) -> Column:
    return F.trim(F.regexp_replace(F.coalesce(c, F.lit("")), r"\s+", " "))


def is_blank(c: Column) -> Column:
    return F.upper(clean(c)).isin(BLANKS)


def authoritative(kind: str, c: Column) -> tuple[Column, Column]:
    """(apply, value) for a field of the kind: star, tip, feature, concern, possibility or stability.

    apply false: leave ours; apply true with a null value: set ours to null."""
    v = clean(c)
    up = F.upper(v)
    n = number_value(v)
    null = F.lit(None).cast("string")
    if kind == "star":
        return ~is_blank(c) & (up.isin("0", "NOT RATED") | v.rlike("^[1-5]$")), F.when(up.isin("0", "NOT RATED"), NOT_RATED).otherwise(v)
    if kind == "tip":
        return up.isin("TIP", "NO TIP", "0", "N", "NO", "NOT RATED"), F.when(up.isin("TIP", "NO TIP"), v).otherwise(null)
    if kind == "feature":
        return up.isin(FEATURE_STATUSES), v
    if kind == "concern":
        return ~is_blank(c) & n.isNull() & ~up.isin("TIP", "NO TIP"), v
    low, high = (0.0, 1.0) if kind == "possibility" else (0.5, 3.0)
    inside = ((n > low) & (n < high)) if kind == "possibility" else ((n >= low) & (n <= high))
    return F.coalesce(inside | (n == 0), F.lit(False)) & ~is_blank(c), F.when(n == 0, null).otherwise(v)


def placeholder(kind: str, c: Column) -> Column:
    """The stored form of a raw value: unrated stars by name, unknown chances and tips as null."""
    v = clean(c)
    if kind == "star":
        return F.when(v == "0", NOT_RATED).otherwise(F.nullif(v, F.lit("")))
    if kind == "possibility":
        return F.when(v.isin("0", "0.0", ""), None).otherwise(v)
    return F.when(F.upper(v).isin("0", "N", "NO", ""), None).otherwise(v)


def unshift(columns: list[str], ok: Column, moved: Column) -> list[Column]:
    """Columns of a row whose values slipped one column to the right, moved back where `moved` holds and `ok` does not."""
    fix = moved & ~ok
    return [F.when(fix, F.col(nxt) if nxt else F.lit(None)).otherwise(F.col(c)).alias(c) for c, nxt in zip(columns, [*columns[1:], None])]
