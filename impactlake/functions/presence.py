"""Presence of keys in JSON kept as VARIANT: a null value and a missing key are different states."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def _path(key: str) -> str:
    return "$['" + key.replace("'", "\\'") + "']"


def has(v: Column, key: str) -> Column:
    return F.try_variant_get(v, _path(key), "variant").isNotNull()


def get(v: Column, key: str, kind: str = "string") -> Column:
    return F.try_variant_get(v, _path(key), kind)


def first_present(v: Column, keys: Sequence[str], kind: str = "string") -> Column:
    """The value under the first key that is there, even if it is null."""
    out = F.lit(None).cast(kind)
    for key in reversed(keys):
        out = F.when(has(v, key), get(v, key, kind)).otherwise(out)
    return out


def any_present(v: Column, keys: Sequence[str]) -> Column:
    out = F.lit(False)
    for key in keys:
        out = out | has(v, key)
    return out


def state(v: Column, key: str) -> Column:
    """missing, null, empty, zero or value."""
    x = F.try_variant_get(v, _path(key), "variant")
    text = get(v, key)
    return F.when(x.isNull(), "missing").when(F.is_variant_null(x), "null").when(text == "", "empty").when(text.isin("0", "0.0"), "zero").otherwise("value")
