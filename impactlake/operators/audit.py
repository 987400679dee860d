"""Audits: duplicates, cardinalities, completeness, gaps, profiles, coverage, capacity, contracts."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numbers import ratio


def union(parts: Sequence[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def duplicate_groups(df: DataFrame, key: list[str]) -> DataFrame:
    """Keys that occur more than once."""
    return df.groupBy(*key).agg(F.count(F.lit(1)).alias("row_count")).where("row_count > 1")


def duplicate_summary(tables: dict[str, tuple[DataFrame, list[str]]]) -> DataFrame:
    """Per table: how many duplicate groups, and rows in them; also where there are none."""
    return union([duplicate_groups(d, k).agg(F.count(F.lit(1)).alias("group_count"), F.coalesce(F.sum("row_count"), F.lit(0)).alias("duplicate_rows")).withColumn("table_name", F.lit(n)) for n, (d, k) in tables.items()])


def duplicate_details(df: DataFrame, key: list[str], source: str, limit: int) -> DataFrame:
    """The first groups by key, with the distinct sources of their rows.

    Sources are made distinct before they are gathered, and only for the groups that are shown."""
    groups = duplicate_groups(df, key).orderBy(*key).limit(limit)
    # at most `limit` groups: safe to broadcast
    rows = df.join(F.broadcast(groups), key).select(*key, "row_count", F.col(source).cast("string").alias("s")).distinct()
    return rows.groupBy(*key, "row_count").agg(F.array_join(F.array_sort(F.collect_set("s")), ",").alias("sources"))


def slot_cardinality(df: DataFrame, key: str, slot: list[str]) -> DataFrame:
    """Rows against distinct slots of each key."""
    by = df.groupBy(key).agg(F.count(F.lit(1)).alias("row_count"), F.count_distinct(*[F.coalesce(F.col(c).cast("string"), F.lit("<NULL>")) for c in slot]).alias("slot_count"))
    return by.withColumn("status", F.when(F.col("row_count") == F.col("slot_count"), "one_row_per_slot").otherwise("multiple_rows_per_slot"))


def missing(expected: DataFrame, actual: DataFrame, on: list[str]) -> DataFrame:
    return expected.join(actual.select(*on), on, "left_anti")


def without_only(df: DataFrame, key: list[str], kind: str, value: str) -> DataFrame:
    """Keys whose kinds are not just the one value."""
    by = df.groupBy(*key).agg(F.bool_or(F.col(kind) != value).alias("_other"), F.count(kind).alias("_n"))
    return by.where(F.coalesce("_other", F.lit(False)) | (F.col("_n") == 0)).select(*key)


def page_gap_ranges(df: DataFrame, key: str, page: str, first: int = 0, most: Column | None = None, expected: DataFrame | None = None) -> DataFrame:
    """Runs of pages that are not there (gap_from, gap_to), between the first page and the last one seen (or `most`); of a key of `expected`
    without any page the first one.  A run is one row however long it is, so one wild page number makes no long array."""
    seen = df.select(key, page).distinct().where(F.col(page) >= first)
    before = F.lag(page).over(Window.partitionBy(key).orderBy(page))
    gaps = seen.select(key, (F.coalesce(before, F.lit(first - 1)) + 1).alias("gap_from"), (F.col(page) - 1).alias("gap_to"))
    if most is not None:
        last = df.where(F.col(page).isNotNull()).groupBy(key).agg(F.max(most).alias("_most"), F.max(F.when(F.col(page) >= first, F.col(page))).alias("_last"))
        gaps = gaps.withColumn("_most", F.lit(None).cast("long")).join(last.select(key, F.col("_most").alias("_m")), key).withColumn("gap_to", F.least("gap_to", "_m")).drop("_most", "_m")
        gaps = gaps.unionByName(last.select(key, (F.coalesce("_last", F.lit(first - 1)) + 1).alias("gap_from"), F.col("_most").alias("gap_to")))
    out = gaps.where(F.col("gap_from") <= F.col("gap_to"))
    if expected is not None:
        out = out.unionByName(expected.select(key).distinct().join(df.select(key), key, "left_anti").select(key, F.lit(first).alias("gap_from"), F.lit(first).alias("gap_to")))
    return out


def page_gaps(df: DataFrame, key: str, page: str, first: int = 0, most: Column | None = None, expected: DataFrame | None = None, chunk: int = 4096) -> DataFrame:
    """Pages between the first and the last one seen that are not there, one a row; of a key of `expected` without any page the first one.

    A long run is cut into pieces of `chunk` pages before it is written out page by page."""
    runs = page_gap_ranges(df, key, page, first, most, expected)
    pieces = runs.select(key, "gap_to", F.explode(F.sequence(F.col("gap_from").cast("long"), F.col("gap_to").cast("long"), F.lit(chunk).cast("long"))).alias("_lo"))
    kind = df.schema[page].dataType
    return pieces.select(key, F.explode(F.sequence("_lo", F.least(F.col("_lo") + chunk - 1, F.col("gap_to").cast("long")))).alias(page)).withColumn(page, F.col(page).cast(kind))


def coverage(full: DataFrame, ours: DataFrame, value: str) -> DataFrame:
    """Full outer: counts of each value on both sides and a status."""
    a = full.groupBy(value).agg(F.count(F.lit(1)).alias("full_count"))
    b = ours.groupBy(value).agg(F.count(F.lit(1)).alias("db_count"))
    out = a.join(b, value, "full").select(value, F.coalesce("full_count", F.lit(0)).alias("full_count"), F.coalesce("db_count", F.lit(0)).alias("db_count"))
    return out.withColumn("status", coverage_status(F.col("full_count"), F.col("db_count")))


def coverage_status(full: Column, ours: Column, thin: float = 0.1) -> Column:
    return F.when(full == 0, "db_only").when(ours == 0, "uncovered").when(ours < full * thin, "thin").otherwise("represented")


def overlap(a: DataFrame, b: DataFrame, on: list[str]) -> DataFrame:
    """One row: distinct keys in both, only left, only right, and the share of the left that is in both.  One shuffle."""
    both = a.select(*on).distinct().withColumn("_l", F.lit(1)).join(b.select(*on).distinct().withColumn("_r", F.lit(1)), on, "full")
    l, r = F.col("_l").isNotNull(), F.col("_r").isNotNull()
    n = both.agg(F.count_if(l & r).alias("both_count"), F.count_if(l & ~r).alias("left_only"), F.count_if(~l & r).alias("right_only"))
    return n.withColumn("overlap_ratio", ratio(F.col("both_count"), F.col("both_count") + F.col("left_only")))


def counter_rows(df: DataFrame, value: str) -> DataFrame:
    return df.where(F.col(value).isNotNull() & (F.col(value).cast("string") != "")).groupBy(F.col(value).cast("string").alias("value")).agg(F.count(F.lit(1)).alias("count"))


def ordered(df: DataFrame, *order, rank: str = "rank", limit: int | None = None) -> DataFrame:
    """A rank by a total order; with a limit by top-k, not by a global sort."""
    if limit is None:
        return df.orderBy(*order)
    return df.orderBy(*order).limit(limit)


def field_profile(observed: DataFrame, key: list[str], test: str) -> DataFrame:
    """Per field: seen, filled, tests, filled share, share of the commonest type."""
    by_type = observed.groupBy(*key, "observed_type").agg(F.count(F.lit(1)).alias("_n"), F.count_if("non_null").alias("_filled"))
    total = by_type.groupBy(*key).agg(F.sum("_n").alias("seen_count"), F.sum("_filled").alias("filled_count"), F.max("_n").alias("_top"))
    tests = observed.groupBy(*key).agg(F.count_distinct(test).alias("test_count"))
    return total.join(tests, key).select(*key, "seen_count", "filled_count", "test_count", ratio(F.col("filled_count"), F.col("seen_count")).alias("filled_ratio"), ratio(F.col("_top"), F.col("seen_count")).alias("type_stability"))


def promotion_score(support: Column, filled: Column, stability: Column, distinct: Column, engineering: Column, conflict: Column, mapped: Column) -> Column:
    one = lambda c, w: F.when(c, F.lit(w)).otherwise(F.lit(0.0))
    return 0.3 * F.least(support, F.lit(1.0)) + 0.2 * filled + 0.2 * stability + 0.1 * (1.0 - F.least(distinct, F.lit(1.0))) + one(engineering, 0.2) - one(conflict, 0.3) - one(mapped, 0.2)


def recommendation(
    support: Column, filled: Column, stability: Column, distinct: Column, distinct_ratio: Column, *,
    semantic: Column, mapped: Column, raw_only: Column, identifier: Column, conflict: Column, numeric: Column, domain: Column, facet: Column, engineering: Column, extra: Column | None = None,
    least_filled: float = 0.10, most_distinct_ratio: float = 0.25,
) -> Column:
    """What to do with a field, as priority:class; first rule wins.

    The flags tell what the field is: part of the scope or the semantic identity, mapped, link or comment, identifier, in conflict, a
    measurement, of a coded domain, a filter of the user, of an engineering endpoint; extra: kept in a column for the rest, which comes before identifiers."""
    strong = support & (filled >= least_filled) & (stability >= 0.95)
    dictionary = distinct.between(2, 100) & (distinct_ratio <= most_distinct_ratio)
    # fixed values: the classes, their priorities and their order
    return (
        F.when(conflict & semantic, "P0:semantic_key_candidate")
        .when(mapped if extra is None else mapped | extra, "P3:raw_only_no_action")
        .when(identifier, "P3:identifier_no_action")
        .when(raw_only, "P3:raw_only_no_action")
        .when(conflict, "P1:conflict_resolution_candidate")
        .when(strong & numeric, "P2:numeric_measurement_column_candidate")
        .when(strong & dictionary & domain, "P2:code_values_candidate")
        .when(strong & dictionary, "P2:dictionary_candidate")
        .when(strong & facet, "P2:facet_candidate")
        .when(strong & engineering, "P1:column_candidate")
        .when(strong, "P2:column_candidate")
        .when(support & (stability < 0.95), "P2:requires_manual_review")
        .otherwise("P3:raw_only_no_action")
    )


# fixed values: what tells the kinds of fields apart, by the lower-cased last name of a path (facets and the identity: by the whole path)
IDENTIFIERS = ["testno", "vehicleno", "curveno", "tstref", "testreferenceno", "id", "rowid", "url", "hash", "path"]
IDENTIFIER_ENDS = ["url", "hash", "path", "id"]
COMMENTS = ["files", "photos", "videos", "reports", "url", "information", "commentary"]
MEASUREMENTS = ["numberoffirstpoint", "numberoflastpoint", "timeincrement", "speed", "weight", "length", "width", "height", "hic", "criterion", "interval", "femur", "load", "metric", "value", "angle", "distance"]
DOMAINS = [
    "sensortype", "sensorattachment", "axisdirofsensor", "datameasurementunits", "datastatus", "channelstatus", "occupantlocation", "occupanttype", "restrainttype", "deployment", "barrierrigidity",
    "rigidor deformablebarrier", "barriershape", "assetkind", "assetsubtype", "testconfigurationkey", "classificationstatus", "participantkind",
]
FACETS = ["make", "model", "year", "type", "configuration", "dummy", "position"]
IDENTITY = ["scope", "semantic"]


def field_flags(path: Column) -> dict[str, Column]:
    """What the path of a field tells `recommendation` about it: semantic, identifier, raw_only, numeric, domain, facet."""
    whole = F.lower(F.coalesce(path, F.lit("")))
    name = F.substring_index(whole, ".", -1)

    def holds(text_: Column, tokens: list[str]) -> Column:
        out = F.lit(False)
        for t in tokens:
            out = out | text_.contains(t)
        return out

    ends = F.lit(False)
    for t in IDENTIFIER_ENDS:
        ends = ends | name.endswith(t)
    return {"semantic": holds(whole, IDENTITY), "identifier": name.isin(IDENTIFIERS) | ends, "raw_only": holds(name, COMMENTS), "numeric": holds(name, MEASUREMENTS), "domain": holds(name, DOMAINS), "facet": holds(whole, FACETS)}


def conflict_class(field: Column, a: Column, b: Column) -> Column:
    """The class of a conflict by its field and values, as priority:class; first rule wins."""
    n, m, name = a.try_cast("double"), b.try_cast("double"), F.lower(F.coalesce(field, F.lit("")))
    # fixed values: the classes, their fields and their order
    return (
        F.when(name.rlike("test_no|test_date|scope"), "P0:semantic_conflict")
        .when(F.coalesce(n == m, F.lit(False)), "P3:numeric_rounding_difference")
        .when(name.contains("occupant_location"), "P3:benign_alias_difference")
        .when(name.rlike("vehicle_speed|vehicle_test_weight"), "P3:unit_representation_difference")
        .when(name.rlike("test_type|configuration|make|model"), "P1:canonical_resolution_needed")
        .otherwise("P2:requires_manual_review")
    )


def table_counts(tables: dict[str, DataFrame]) -> DataFrame:
    return union([d.agg(F.count(F.lit(1)).alias("row_count")).withColumn("table_name", F.lit(n)) for n, d in tables.items()])


def capacity(counts: DataFrame, ours: int, full: int) -> DataFrame:
    """Row counts scaled from our tests to all, half-even."""
    return counts.withColumn("estimated_rows", F.bround(F.col("row_count") * F.lit(full / ours)).cast("long"))


def runtime(counts: DataFrame, ours: int, full: int, delays: Sequence[float] = (0.1, 0.2, 0.5, 1.0)) -> DataFrame:
    """endpoint requests scaled from our tests to all (row_count a row an endpoint), and for each delay the hours that all of them wait."""
    total = capacity(counts, ours, full).agg(F.coalesce(F.sum("estimated_rows"), F.lit(0)).alias("request_count"))
    each = total.select("request_count", F.explode(F.array(*map(F.lit, delays))).alias("delay_seconds"))
    return each.withColumn("delay_hours", F.bround(F.col("request_count") * F.col("delay_seconds") / 3600, 2))


def value_profile(df: DataFrame, fields: Sequence[str], top: int = 12) -> DataFrame:
    """Per field: filled, distinct, and the most frequent values with counts, ties by value."""
    cells = F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).cast("string").alias("value")) for f in fields])
    counts = df.select(F.explode(cells).alias("c")).select("c.*").where("value is not null and value <> ''").groupBy("field", "value").agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy("field").orderBy(F.desc("n"), "value")
    # one window would rank every value of a field in one task: the top of each hash part first, then of the field
    part = F.pmod(F.xxhash64("value"), F.lit(64))
    local = Window.partitionBy("field", part).orderBy(F.desc("n"), "value")
    best = counts.withColumn("_r", F.row_number().over(local)).where(F.col("_r") <= top).withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= top)
    tops = best.groupBy("field").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_r", "value", "n"))), lambda x: F.concat(x["value"], F.lit("="), x["n"].cast("string"))), "; ").alias("top_values"))
    totals = counts.groupBy("field").agg(F.sum("n").alias("filled_count"), F.count(F.lit(1)).alias("distinct_count"))
    return totals.join(tops, "field")


def contract_violations(tables: dict[str, DataFrame], spec: dict[str, tuple[list[str], list[str]]]) -> list[str]:
    """Messages for missing tables, missing columns and keys that repeat; spec: table -> (columns, unique key)."""
    out = []
    for name, (cols, key) in spec.items():
        if name not in tables:
            out.append(f"{name}: missing")
            continue
        lacking = [c for c in cols if c not in tables[name].columns]
        if lacking:
            out.append(f"{name}: lacks {', '.join(lacking)}")
        elif key and not duplicate_groups(tables[name], key).isEmpty():
            out.append(f"{name}: {', '.join(key)} repeats")
    return out


def gate(df: DataFrame, checks: dict[str, Column]) -> None:
    """Raise with the names of all checks (aggregate conditions) that do not hold."""
    row = df.agg(*[c.alias(n) for n, c in checks.items()]).first()
    failed = [n for n in checks if not row[n]]
    if failed:
        raise ValueError(f"gates failed: {', '.join(failed)}")


def bottlenecks(estimates: DataFrame, least: int = 1_000_000, limit: int = 10) -> DataFrame:
    """The largest tables by estimated rows, of those with at least `least`."""
    return estimates.where(F.col("estimated_rows") >= least).orderBy(F.desc("estimated_rows"), "table_name").limit(limit)


def storage_advice(size_bytes: Column, lineage_rows: Column) -> Column:
    """Where a catalog of that size and that many estimated lineage rows should live."""
    # fixed values: the bounds and the answers
    return (
        F.when(size_bytes > 5_000_000_000, "postgresql_recommended_before_full_scale")
        .when(lineage_rows > 5_000_000, "sqlite_possible_but_postgresql_preferred_for_lineage_queries")
        .otherwise("sqlite_possible_for_full_scale_metadata_only")
    )
