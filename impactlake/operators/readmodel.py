"""Read models: filter summary, facets, asset summary, classification, code values, and the queries over them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text


def distinct_sorted(c: str) -> Column:
    """Distinct non-empty values as a sorted array."""
    return F.array_sort(F.collect_set(F.nullif(F.col(c), F.lit(""))))


def summary(base: DataFrame, children: DataFrame, key: str, low_high: str, lists: dict[str, str], flag: Column, flag_name: str) -> DataFrame:
    """Per key: least and greatest of a column (zeros count, nulls do not), sorted distinct lists, and whether any child has the flag."""
    by = children.groupBy(key).agg(F.min(low_high).alias(f"{low_high}_min"), F.max(low_high).alias(f"{low_high}_max"), *[distinct_sorted(c).alias(n) for n, c in lists.items()], F.coalesce(F.bool_or(flag), F.lit(False)).alias(flag_name))
    out = base.join(by, key, "left")
    for n in lists:
        out = out.withColumn(n, F.coalesce(n, F.array().cast("array<string>")))
    return out.withColumn(flag_name, F.coalesce(flag_name, F.lit(False)))


def _cells(c: str) -> Column:
    return F.transform(F.array_distinct(F.col(c)), lambda x: F.struct(F.lit(c).alias("facet_name"), x.cast("string").alias("facet_value")))


def facets(df: DataFrame, scalars: Sequence[str] = (), arrays: Sequence[str] = ()) -> DataFrame:
    """(facet_name, facet_value, facet_count): +1 a row and distinct value; null and empty values do not count.  One pass, one shuffle."""
    cells = F.concat(
        F.array(*[F.struct(F.lit(c).alias("facet_name"), F.col(c).cast("string").alias("facet_value")) for c in scalars]) if scalars else F.array().cast("array<struct<facet_name:string,facet_value:string>>"),
        *[_cells(c) for c in arrays],
    )
    each = df.select(F.explode(cells).alias("f")).select("f.*").where("facet_value is not null and facet_value <> ''")
    return each.groupBy("facet_name", "facet_value").agg(F.count(F.lit(1)).alias("facet_count"))


def facets_distinct(df: DataFrame, key: str, names: Sequence[str]) -> DataFrame:
    """Facets that count distinct keys a value."""
    cells = F.array(*[F.struct(F.lit(c).alias("facet_name"), F.col(c).cast("string").alias("facet_value")) for c in names])
    each = df.select(key, F.explode(cells).alias("f")).select(key, "f.*").where("facet_value is not null and facet_value <> ''")
    return each.groupBy("facet_name", "facet_value").agg(F.count_distinct(key).alias("facet_count"))


def top_facets(f: DataFrame, k: int) -> DataFrame:
    """The k most frequent values of each facet, ties by value.

    A facet may have as many values as the table has rows: the best of each hash part are ranked first, then those of the facet."""
    best = [F.desc("facet_count"), "facet_value"]
    part = F.pmod(F.xxhash64("facet_value"), F.lit(64))
    local = f.withColumn("facet_rank", F.row_number().over(Window.partitionBy("facet_name", part).orderBy(*best))).where(F.col("facet_rank") <= k)
    return local.withColumn("facet_rank", F.row_number().over(Window.partitionBy("facet_name").orderBy(*best))).where(F.col("facet_rank") <= k)


def code_values(sources: list[tuple[str, DataFrame, str, str]]) -> DataFrame:
    """(code_set, display_value, normalized_value, row_count, test_count, first_test): sources are (code set, table, column, test id)."""
    parts = [d.select(F.lit(name).alias("code_set"), text.display_value(F.col(c)).alias("display_value"), F.col(t).cast("long").alias("_t")) for name, d, c, t in sources]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.where("display_value is not null").groupBy("code_set", "display_value").agg(F.count(F.lit(1)).alias("row_count"), F.count_distinct("_t").alias("test_count"), F.min("_t").alias("first_test")).withColumn("normalized_value", text.code_value(F.col("display_value")))


def asset_summary(df: DataFrame, key: str, kind: str) -> DataFrame:
    return df.groupBy(key, kind).agg(F.count(F.lit(1)).alias("asset_count"))


def impact_direction(angle: Column) -> Column:
    a = F.pmod(angle, F.lit(360))
    return F.when(angle.isNull(), "unknown").when((a <= 45) | (a >= 315), "frontal").when((a >= 135) & (a <= 225), "rear").otherwise("side")


def counterparty(kinds: Column, subjects: Column) -> Column:
    """Of the kinds (array) of participants and the number of subjects."""
    return F.when(F.array_contains(kinds, "barrier"), "barrier").when(F.array_contains(kinds, "impactor_vehicle"), "impactor_vehicle").when(subjects >= 2, "vehicle").otherwise("unknown")


# fixed values: (family, phrases), first hit wins
FAMILIES = [
    ("adas_fcw", ["FORWARD COLLISION WARNING", " FCW"]),
    ("adas_ldw", ["LANE DEPARTURE WARNING", " LDW"]),
    ("adas_other", ["TRAFFIC JAM ASSIST"]),
    ("pedestrian", ["PEDESTRIAN"]),
    ("low_risk_deployment", ["LOW RISK DEPLOYMENT"]),
    ("sled_with_body", ["SLED WITH VEHICLE BODY"]),
    ("sled_without_body", ["SLED WITHOUT VEHICLE BODY"]),
    ("static_airbag", ["STATIC AIR BAG TEST SIDE", "OUT OF POSITION"]),
    ("rollover", ["ROLLOVER"]),
    ("child_restraint", ["FMVSS 213", "CHILD RESTRAINT"]),
    ("calibration", ["CALIBRATION"]),
    ("research_other", ["RESEARCH"]),
]


def family(words: Column, direction: Column, other: Column) -> Column:
    """The family of a test by phrases in its upper-cased texts, else by direction and counterparty."""
    from .canonical import cascade

    rest = F.when((direction == "frontal") & (other == "barrier"), "frontal_barrier").when((direction == "side") & (other == "impactor_vehicle"), "side_impactor").when(direction != "unknown", direction).otherwise("unknown")
    return cascade(words, FAMILIES, rest)


def list_filtered(df: DataFrame, equal: dict[str, object], contains: dict[str, str]) -> DataFrame:
    """Rows that all filters hold for.  Empty filter values do not filter."""
    out = df
    for c, v in equal.items():
        if v not in (None, ""):
            out = out.where(F.col(c) == v)
    for c, v in contains.items():
        if v not in (None, ""):
            out = out.where(F.array_contains(c, v))
    return out


def list_page(df: DataFrame, equal: dict[str, object], contains: dict[str, str], order: list[str], offset: int = 0, limit: int = 5000) -> DataFrame:
    """Filter, stable order, page; `list_total` has the count of all pages."""
    if offset < 0 or limit < 0:
        raise ValueError("offset and limit must not be negative")
    return list_filtered(df, equal, contains).orderBy(*order).offset(offset).limit(limit)


def list_total(df: DataFrame, equal: dict[str, object], contains: dict[str, str]) -> DataFrame:
    """One row: how many rows the filters hold for, whatever the page."""
    return list_filtered(df, equal, contains).agg(F.count(F.lit(1)).alias("total"))


def taxonomy_groups(f: DataFrame, taxonomy: list[tuple[str, str]], spark) -> DataFrame:
    """Facet counts summed by group, groups in the taxonomy's order; the taxonomy is a small constant."""
    order = {g: i for i, g in enumerate(dict.fromkeys(g for _, g in taxonomy))}
    t = spark.createDataFrame([(v, g, order[g]) for v, g in taxonomy], "facet_value string, group_name string, group_order int")
    return f.join(F.broadcast(t), "facet_value").groupBy("group_name", "group_order").agg(F.sum("facet_count").alias("group_count"))
