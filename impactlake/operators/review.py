"""Review of recommendations by hand, scope of a manifest, and baselines."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Decision and classes that need a person, name tokens, actions by class, risks by priority.
DECISION = "requires_manual_domain_review"
CLASSES = ["requires_manual_review", "conflict_resolution_candidate"]
RAW_TOKENS = ["testno", "vehicleno", "curveno", "url", "hash"]
MEASURE_TOKENS = ["speed", "weight", "height", "length", "value"]
ACTIONS = {
    "code_values_candidate": "new_code_value_candidate",
    "dictionary_candidate": "new_code_value_candidate",
    "column_candidate": "new_column_candidate",
    "alias_map_candidate": "map_to_existing_column",
}
RISKS = {"P0": "high", "P1": "high", "P2": "medium"}


def _lookup(table: dict[str, str], key: Column, otherwise: str) -> Column:
    pairs = F.create_map(*[F.lit(x) for pair in table.items() for x in pair])
    return F.coalesce(pairs[key], F.lit(otherwise))


def action(target: Column, kind: Column) -> Column:
    """What to do with a field: its name decides first, then the class of the recommendation."""
    name = F.lower(F.coalesce(target, F.lit("")))
    by_name = F.when(name.rlike("|".join(RAW_TOKENS)), "raw_only").when(name.rlike("|".join(MEASURE_TOKENS)), "new_column_candidate")
    return by_name.otherwise(_lookup(ACTIONS, kind, "defer"))


def backlog(recommendations: DataFrame, target: str, decision: str, kind: str, priority: str) -> DataFrame:
    """Recommendations that a person must look at, with candidate_action and risk."""
    needed = F.coalesce(F.col(decision) == DECISION, F.lit(False)) | F.coalesce(F.col(kind).isin(CLASSES), F.lit(False))
    return recommendations.where(needed).withColumns({"candidate_action": action(F.col(target), F.col(kind)), "risk": _lookup(RISKS, F.col(priority), "low")})


def backlog_summary(rows: DataFrame) -> DataFrame:
    """One row: how many of each risk, and whether the high ones block the full run."""
    counts = [F.count_if(F.col("risk") == r).alias(f"{r}_risk") for r in ("high", "medium", "low")]
    return rows.agg(F.count(F.lit(1)).alias("total"), *counts).withColumn("full_scale_blocked", F.col("high_risk") > 0)


def scope_violations(manifest: DataFrame, key: str, date: str, least: str) -> DataFrame:
    """One row: rows without key, without date, and before the scope; a manifest is valid if all are 0."""
    early = F.col(date) < F.lit(least).cast("date")
    return manifest.agg(F.count_if(F.col(key).isNull()).alias("missing_key"), F.count_if(F.col(date).isNull()).alias("missing_date"), F.count_if(early).alias("before_scope"))


def baseline(tables: dict[str, DataFrame], least: dict[str, int]) -> DataFrame:
    """table_name, row_count, least, passed, message: whether each table has as many rows as it must."""

    def one(name: str) -> DataFrame:
        n, want = F.col("row_count"), F.lit(least[name])
        counted = tables[name].agg(F.count(F.lit(1)).alias("row_count"))
        said = F.when(n >= want, "ok").otherwise(F.concat(F.lit(f"{name}: "), n.cast("string"), F.lit(f" rows, {least[name]} needed")))
        return counted.select(F.lit(name).alias("table_name"), "row_count", want.cast("long").alias("least"), (n >= want).alias("passed"), said.alias("message"))

    return reduce(DataFrame.unionByName, map(one, least))
