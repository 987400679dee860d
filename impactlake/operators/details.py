"""Provenance, rebuilds, completeness, nested details, model lookups and picks by quota."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import session
from ..functions import presence, text, vehicles
from ..functions.numbers import ratio
from .canonical import cascade

PART = 1 << 19  # rows a task is given by `spread` at most, but for a key that has more


def spread(df: DataFrame, rows: int, *by: str) -> DataFrame:
    """df dealt out by columns into as many parts as its number of rows asks for, so that the memory of a task does not grow with the table."""
    return df.repartition(max(1, -(-rows // PART)), *by)


def rebuild(rows: DataFrame, fresh: DataFrame, again: DataFrame, key: str, size: int | None = None) -> DataFrame:
    """A table after some tests were derived again: all their rows are replaced by the fresh ones, those of others stay.

    A test of `again` without fresh rows (out of scope by now) has none afterwards; fresh rows of other tests are ignored.
    size: how many rows `rows` and `fresh` have at most, each; with it keys are dealt into parts as `spread` deals such rows, so rows that
    were spread by the key are not moved again.  A part's keys are held in memory, and rows pass by them unsorted."""
    keys = again.select(key)
    keys = (keys if size is None else spread(keys, size, key)).distinct()
    if size is not None:
        keys = keys.hint("shuffle_hash")
    return rows.join(keys, key, "left_anti").unionByName(fresh.join(keys, key, "left_semi"))


def resume(wanted: DataFrame, done: DataFrame, runs: DataFrame | None, key: str, stale: Column | None = None) -> DataFrame:
    """Tests that are still to do: wanted, not done, and not held by a run that is neither over nor stale."""
    left = wanted.select(key).distinct().join(done.select(key), key, "left_anti")
    return left if runs is None else left.join(runs.where(~F.coalesce(stale, F.lit(False))).select(key), key, "left_anti")


def close_stale(runs: DataFrame, at: Column, reason: str) -> DataFrame:
    """Runs (status, finished_at, error_type, error_message) after those that began and never ended are closed as interrupted; no run holds its tests then."""
    open_ = (F.col("status") == "started") & F.col("finished_at").isNull()
    new = {"status": F.lit("interrupted"), "finished_at": at, "error_type": F.lit("InterruptedRun"), "error_message": F.lit(reason)}
    return runs.select(*[F.when(F.coalesce(open_, F.lit(False)), new[c]).otherwise(F.col(c)).alias(c) if c in new else F.col(c) for c in runs.columns])


def observation_summary(payloads: DataFrame, observations: DataFrame, key: str, endpoint: str, at: Column) -> DataFrame:
    """Per endpoint: payloads that were seen, how often, first and last.  Observations are counted by payload before the join."""
    seen = observations.groupBy(key).agg(F.count(F.lit(1)).alias("_n"), F.min(at).alias("_lo"), F.max(at).alias("_hi"))
    by = payloads.select(key, F.col(endpoint).alias("endpoint")).join(seen, key).groupBy("endpoint")
    return by.agg(F.count(F.lit(1)).alias("payload_count"), F.sum("_n").alias("observation_count"), F.min("_lo").alias("first_seen"), F.max("_hi").alias("last_seen"))


def named_sources(rows: DataFrame, sources: DataFrame, key: str, name: str, default: str = "unknown") -> DataFrame:
    """Rows with the name of their source; what no source is known for is called `default`."""
    return rows.join(sources.select(key, F.col(name).alias("source_name")), key, "left").withColumn("source_name", F.coalesce("source_name", F.lit(default)))


def path_rollup(rows: DataFrame, path: Column, filled: Column) -> DataFrame:
    """Fields by path, positions in lists written as [*]: how often seen and how often filled."""
    plain = F.regexp_replace(path, r"\[\d+\]", "[*]")
    return rows.groupBy(plain.alias("field_path")).agg(F.count(F.lit(1)).alias("seen"), F.count_if(filled).alias("filled"))


def shares(df: DataFrame, value: Column, name: str) -> DataFrame:
    """How many rows each value has, and which share of all."""
    by = df.groupBy(value.alias(name)).agg(F.count(F.lit(1)).alias("n"))
    total = df.agg(F.count(F.lit(1)).alias("_all"))
    return by.crossJoin(F.broadcast(total)).select(name, "n", ratio(F.col("n"), F.col("_all")).alias("share"))  # the right side is one row


def completeness(expected: DataFrame, found: Mapping[str, DataFrame], key: str) -> DataFrame:
    """Per endpoint: expected, found and missing keys.  One join for all endpoints."""
    out = expected.select(key).distinct()
    for i, df in enumerate(found.values()):
        out = out.join(df.select(key).distinct().withColumn(f"_has{i}", F.lit(True)), key, "left")
    n = out.agg(F.count(F.lit(1)).alias("_n"), *[F.count_if(F.col(f"_has{i}")).alias(f"_f{i}") for i in range(len(found))])
    each = F.array(*[F.struct(F.lit(name).alias("endpoint"), F.col("_n").alias("expected"), F.col(f"_f{i}").alias("found"), (F.col("_n") - F.col(f"_f{i}")).alias("missing")) for i, name in enumerate(found)])
    return n.select(F.explode(each).alias("e")).select("e.*")


def reference_sentence(references: Column) -> Column:
    """The sentence that names the reference tests of a test (a sorted array of texts; null or empty: none)."""
    names, n = F.array_join(references, ", "), F.size(references)
    one = F.concat(F.lit("Reference test "), names, F.lit("."))
    return F.when(references.isNull() | (n == 0), "No reference test.").when(n == 1, one).otherwise(F.concat(F.lit("Reference tests "), names, F.lit(".")))


def identity(payload: Column, paths: Sequence[str], keys: Mapping[str, tuple[Sequence[str], str]]) -> list[Column]:
    """What a payload says about a vehicle: of the objects at the paths the first that is there; keys: name -> (keys to try, type)."""
    at = F.coalesce(*[F.try_variant_get(payload, p, "variant") for p in paths])
    return [presence.first_present(at, tuple(names), kind).alias(name) for name, (names, kind) in keys.items()]


def whitelisted(df: DataFrame, column: str, codes: Sequence[str]) -> DataFrame:
    """Rows whose value, in the form of a code, is one of the codes."""
    return df.where(text.code_value(F.col(column)).isin(list(codes)))


def with_child(df: DataFrame, children: DataFrame, key: str, wanted: Column) -> DataFrame:
    """Rows that have a child the condition holds for; no list of children is built."""
    return df.join(children.where(wanted).select(key), key, "left_semi")


def kind_counts(df: DataFrame, *by: str) -> DataFrame:
    """Assets by test, kind and further columns."""
    return df.groupBy(*by).agg(F.count(F.lit(1)).alias("asset_count"))


def code_set_coverage(values: DataFrame) -> DataFrame:
    """Per code set: values and rows (of `readmodel.code_values`)."""
    return values.groupBy("code_set").agg(F.count(F.lit(1)).alias("value_count"), F.sum("row_count").alias("row_count"))


def by_table(value: Column, table: Mapping[str, str], default: str) -> Column:
    """The class of a value by a small table; a class for all others."""
    known = F.create_map(*[F.lit(x) for pair in table.items() for x in pair])
    return F.coalesce(F.try_element_at(known, value), F.lit(default))


def detail(tests: DataFrame, children: Mapping[str, tuple[DataFrame, Sequence[str]]], key: str) -> DataFrame:
    """Tests with their children nested: name -> (table, columns), sorted by those columns; without children an empty list.

    Children are kept to those of the tests before they are gathered, so `tests` should be the few that are asked for.  Tests and the children of
    all kinds are written once; their numbers tell into how many parts they are dealt, and one grouping gathers all kinds."""
    spark = tests.sparkSession
    folder = session.workspace(spark)
    asked = session.kept(tests, f"{folder}/tests")
    keys = asked.select(key).distinct().hint("shuffle_hash")
    rows = None
    for name, (df, columns) in children.items():
        some = df.join(keys, key, "left_semi").select(key, F.struct(*columns).alias(name))
        rows = some if rows is None else rows.unionByName(some, allowMissingColumns=True)
    if rows is None:
        return asked
    rows = session.kept(rows, f"{folder}/children")
    size = max(rows.count(), asked.count())
    nested = spread(rows, size, key).groupBy(key).agg(*[F.array_sort(F.collect_list(name)).alias(name) for name in children])
    out = spread(asked, size, key).join(nested, key, "left")
    return out.select(*[F.coalesce(F.col(c), F.array().cast(nested.schema[c].dataType)).alias(c) if c in children else F.col(c) for c in out.columns])


def model_matches(subjects: DataFrame, models: DataFrame, subject: str, make: str = "make", model: str = "model", name: str = "api_model", least: int = 76, most: int = 8, year: str | None = None) -> DataFrame:
    """For each subject the models of its make (and year) whose names fit best: of one score only, at least `least`, at most `most`, short names first.

    A make counts under all its names, so match_make may differ from the subject's.  models: make, name and year if that is named; they are scored once
    for each distinct make, year and model of the subjects."""
    by = [make, *([year] if year else [])]
    asked = subjects.select(*[F.col(c).alias(f"_{i}") for i, c in enumerate(by)], F.col(model).alias("_model")).distinct()
    named = asked.withColumn("match_make", F.explode(vehicles.make_aliases(F.col("_0"))))
    listed = models.select(text.squash(F.upper(make)).alias("match_make"), *([F.col(year).alias("_1")] if year else []), F.col(name)).distinct()
    pairs = named.join(listed, ["match_make", *(["_1"] if year else [])])
    scored = pairs.withColumn("score", vehicles.model_name_score(F.col("_model"), F.col(name), F.col("match_make"))).where(F.col("score") >= least)
    own = [*[f"_{i}" for i in range(len(by))], "_model"]
    best = scored.withColumn("_best", F.max("score").over(Window.partitionBy(*own))).where("score = _best").drop("_best")
    order = Window.partitionBy(*own).orderBy(F.length(name), name, "match_make")
    kept = best.withColumn("match_rank", F.row_number().over(order)).where(F.col("match_rank") <= most)
    return subjects.select(subject, *[F.col(c).alias(f"_{i}") for i, c in enumerate(by)], F.col(model).alias("_model")).join(kept, own).select(subject, "match_make", name, "score", "match_rank")


def quota_pick(df: DataFrame, bucket: str, order: list[str], quota: Mapping[object, int], prior: Mapping[object, int], take: int) -> DataFrame:
    """`take` rows, one after another from the bucket that is furthest below its quota, ties by `order` (a total order).

    prior: rows that each bucket has already.  The k-th row of a bucket is taken when the bucket stands at prior + k - 1 - quota, and that
    number only grows along a bucket, so the walk takes rows in the order of (that number, order): a rank and a top-k, no loop."""
    table = {b: prior.get(b, 0) - quota.get(b, 0) for b in {*quota, *prior}}
    known = F.create_map(*[F.lit(x) for pair in table.items() for x in pair]) if table else None
    start = F.coalesce(F.try_element_at(known, F.col(bucket)), F.lit(0)) if table else F.lit(0)
    level = F.row_number().over(Window.partitionBy(bucket).orderBy(*order)) - 1 + start
    return df.withColumn("quota_level", level).orderBy("quota_level", *order).limit(take)


# fixed values: (family, phrases) of tests in a manifest, first hit wins; phrases that begin with a blank are words
MANIFEST_FAMILIES = [
    ("side_impactor", ["IMPACTOR INTO VEHICLE", " ITV"]),
    ("frontal_barrier", ["VEHICLE INTO BARRIER", " VTB"]),
    ("pole", ["VEHICLE INTO POLE", " VTP"]),
    ("vehicle_to_vehicle", ["VEHICLE INTO VEHICLE", " VTV"]),
    ("rollover", ["ROLLOVER"]),
    ("sled", ["SLED"]),
    ("airbag_static_or_low_risk", ["LOW RISK", "STATIC"]),
    ("non_crash_adas", ["WARNING", "ASSIST"]),
]


def manifest_family(*texts: Column) -> Column:
    """The family of a test by its configuration key, configuration and type, as manifests have them (not as the read model classifies)."""
    words = F.concat(F.lit(" "), F.upper(F.concat_ws(" ", *[F.nullif(c, F.lit("")) for c in texts])))
    return cascade(words, MANIFEST_FAMILIES, "unknown_or_other")


def legacy_restraint_key(test_id: Column, vehicle_no: Column, location: Column, restraint_type: Column, deployment: Column, data: Column) -> Column:
    """The key that audits fall back to: seven named parts in a fixed order; data: the source row (VARIANT), for place and mount."""
    # fixed values: the names of the parts and the keys of the source row
    parts = {
        "test_id": test_id,
        "vehicle_scope_key": vehicle_no,
        "occupant_scope_key": location,
        "restraint_type_key": restraint_type,
        "restraint_location_key": presence.first_present(data, ("restraintLocation", "location", "RSTLOCD")),
        "deployment_status_key": deployment,
        "mount_or_system_key": presence.first_present(data, ("restraintSystem", "system", "mount", "mountingLocation", "airbagLocation")),
    }
    return F.concat_ws("|", *[F.concat(F.lit(f"{name}="), text.semantic_value(c)) for name, c in parts.items()])


def with_lookups(tests: DataFrame, key: str, **lookups: tuple[DataFrame, Sequence[str]]) -> DataFrame:
    """Tests with columns of their participant, summary or classification rows (one a test), named lookup_column; null where there is none."""
    out = tests
    for name, (df, columns) in lookups.items():
        out = out.join(df.select(key, *[F.col(c).alias(f"{name}_{c}") for c in columns]), key, "left")
    return out
