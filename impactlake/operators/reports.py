"""Report building blocks: patterns, cardinalities, coverage of fields, readiness, nested outputs."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import ratings, text
from ..functions.numbers import ratio
from .composed import Section, key_counts
from .details import manifest_family


def patterns(df: DataFrame, key: str, kind: str) -> DataFrame:
    """How many keys have each pattern of kinds, such as 'barrier:1, subject:2'.  Kinds are few, so an array of them is small."""
    by = df.groupBy(key, kind).agg(F.count(F.lit(1)).alias("n"))
    one = by.groupBy(key).agg(F.array_join(F.array_sort(F.collect_list(F.concat(F.col(kind), F.lit(":"), F.col("n").cast("string")))), ", ").alias("pattern"))
    return one.groupBy("pattern").agg(F.count(F.lit(1)).alias("key_count"))


def assignment_cardinality(df: DataFrame, key: str, assigned: Column, lost: Column) -> DataFrame:
    return df.groupBy(key).agg(F.count(F.lit(1)).alias("row_count"), F.count_if(assigned).alias("assigned_count"), F.count_if(lost).alias("context_lost"))


def semantic_cardinality(df: DataFrame, key: str, parts: Sequence[str], source: str) -> DataFrame:
    """Rows, distinct semantic keys and distinct sources a key, and what that says."""
    by = df.groupBy(key).agg(F.count(F.lit(1)).alias("row_count"), F.count_distinct(text.semantic_hash(**{p: F.col(p) for p in parts})).alias("key_count"), F.count_distinct(source).alias("source_count"))
    return by.withColumn("status", F.when(F.col("row_count") == F.col("key_count"), "unique").when(F.col("source_count") > 1, "merged_sources").otherwise("repeated"))


def scope_summary(df: DataFrame, date: str, status: Column, least: str) -> DataFrame:
    inside = F.when(F.col(date).isNull(), "missing_test_date").when(status != "parsed", "date_parse_failed").when(F.col(date) >= F.lit(least).cast("date"), "in_scope").otherwise("out_of_scope")
    return df.groupBy(inside.alias("scope")).agg(F.count(F.lit(1)).alias("n"))


def manifest_summary(df: DataFrame, key: str, date: str) -> DataFrame:
    """One row: rows, distinct keys, repeats, first and last date."""
    n = df.agg(F.count(F.lit(1)).alias("row_count"), F.count_distinct(key).alias("distinct_count"), F.min(date).alias("first_date"), F.max(date).alias("last_date"))
    return n.withColumn("duplicate_count", F.col("row_count") - F.col("distinct_count"))


def field_coverage(ours: DataFrame, theirs: DataFrame, fields: Sequence[str]) -> DataFrame:
    """Filled values of each field on both sides, and a status."""
    def filled(d: DataFrame, name: str) -> DataFrame:
        n = d.agg(*[F.count_if(F.coalesce(F.trim(F.col(f).cast("string")), F.lit("")) != "").alias(f) for f in fields])
        return n.unpivot([], list(fields), "field", name)

    out = filled(ours, "ours_filled").join(filled(theirs, "theirs_filled"), "field")
    a, b = F.col("ours_filled"), F.col("theirs_filled")
    return out.withColumn("status", F.when(b == 0, "not_in_source").when(a == 0, "not_stored").when(a < b, "partly_stored").otherwise("stored"))


def distribution(df: DataFrame, value: Column, name: str) -> DataFrame:
    return df.groupBy(F.coalesce(value.cast("string"), F.lit("<NULL>")).alias(name)).agg(F.count(F.lit(1)).alias("n"))


def histograms(df: DataFrame, values: Mapping[str, Column], where: Mapping[str, Column] | None = None) -> DataFrame:
    """name, value and n of several distributions of a table by one scan; where: which rows a distribution is of (all by default); nulls are <NULL>."""
    sections = {name: Section(c, (where or {}).get(name)) for name, c in values.items()}
    return key_counts(df, sections).select(F.col("section").alias("name"), F.col("key").alias("value"), "n")


def manifest_distributions(df: DataFrame, year: Column, test_type: Column, configuration: Column, configuration_key: Column) -> DataFrame:
    """The four distributions of a manifest: year, type, configuration (trimmed; empty as <NULL>) and family."""
    shown = lambda c: F.nullif(F.trim(c), F.lit(""))
    return histograms(df, {"year": year, "test_type": shown(test_type), "configuration": shown(configuration), "family": manifest_family(configuration_key, configuration, test_type)})


def match_rate(df: DataFrame, ready: Column, matched: Column) -> DataFrame:
    """One row: subjects, ready ones, matched ones, rate to six places."""
    n = df.agg(F.count(F.lit(1)).alias("subject_count"), F.count_if(ready).alias("ready_count"), F.count_if(ready & matched).alias("matched_count"))
    return n.withColumn("match_rate", ratio(F.col("matched_count"), F.col("ready_count"), 6))


def subject_groups(df: DataFrame, key: str, rank: str, columns: Sequence[str], most: int = 8) -> DataFrame:
    """A row a subject with its (at most `most`) candidates nested in rank order."""
    top = df.where(F.col(rank) <= most)
    return top.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(rank, *columns))).alias("candidates"))


def with_priority(df: DataFrame, order: list, name: str = "selection_priority") -> DataFrame:
    """A running number over few selected rows (the selection is limited before)."""
    return df.withColumn(name, F.row_number().over(Window.orderBy(*order)))


def required_facets(f: DataFrame, required: Sequence[str], spark) -> DataFrame:
    """Which of the required facets are there."""
    want = spark.createDataFrame([(r,) for r in required], "facet_name string")
    have = f.select("facet_name").distinct().withColumn("present", F.lit(True))
    return want.join(have, "facet_name", "left").withColumn("present", F.coalesce("present", F.lit(False)))


def capped(df: DataFrame, key: str, order: list, each: int, all_: int) -> DataFrame:
    """At most `each` rows a key and `all_` in all, with the uncapped count of each key."""
    w = Window.partitionBy(key).orderBy(*order)
    counts = df.groupBy(key).agg(F.count(F.lit(1)).alias("total_count"))
    return df.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= each).drop("_n").join(counts, key).orderBy(key, *order).limit(all_)


def drift(a: dict[str, Column], b: dict[str, Column]) -> Column:
    """Names of fields that differ; blank on either side does not count."""
    norm = lambda c: F.upper(F.trim(F.coalesce(c.cast("string"), F.lit(""))))
    return text.compact(*[text.flag(k, (norm(a[k]) != "") & (norm(b[k]) != "") & (norm(a[k]) != norm(b[k]))) for k in a])


def fields_payload(fields: dict[str, tuple[str, Column]]) -> Column:
    """Compact JSON of the fields that say something; keys sorted; fields: name -> (kind, column)."""
    pairs = []
    for name in sorted(fields):
        kind, c = fields[name]
        apply, value = ratings.authoritative(kind, c)
        pairs.append(F.when(apply & value.isNotNull(), F.struct(F.lit(name).alias("key"), value.alias("value"))))
    return F.to_json(F.map_from_entries(F.array_compact(F.array(*pairs))))


def release_reason(release: Column, description: Column) -> Column:
    """Whether a candidate's release fits what a test says."""
    d, r = F.upper(description), F.upper(F.coalesce(release, F.lit("")))
    early, later = d.contains("EARLY RELEASE"), d.contains("LATER RELEASE")
    return F.when(r.contains("EARLY") & early | r.contains("LATER") & later, "release_match").when(r.contains("EARLY") & later | r.contains("LATER") & early, "release_conflict").when(early | later, "release_unstated").otherwise("no_release")


def triage(status: Column, n: Column, least: int) -> Column:
    return F.when(status == "mapped", "done").when(n < least, "watch").when(status == "conflict", "manual_review").otherwise("promote")
