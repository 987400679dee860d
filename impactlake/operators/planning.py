"""Collection planning: dedupe, caps, quotas, rarity, set differences, authority."""

from __future__ import annotations

from collections.abc import Iterator, Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def best_row(df: DataFrame, key: list[str], order: list) -> DataFrame:
    """One row a key, the first by order."""
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).where("_n = 1").drop("_n")


def stratified(df: DataFrame, bucket: str, cap: int, order: list, limit: int, required: Column | None = None) -> DataFrame:
    """Rows in order, at most `cap` a bucket (required ones count but always stay), then at most `limit` in all, required first."""
    need = F.coalesce(required, F.lit(False)) if required is not None else F.lit(False)
    rows = df.withColumn("_need", need)
    w = Window.partitionBy(bucket).orderBy(F.desc("_need"), *order)
    kept = rows.withColumn("_n", F.row_number().over(w)).where(F.col("_need") | (F.col("_n") <= cap))
    return kept.orderBy(F.desc("_need"), *order).limit(limit).drop("_need", "_n")


def rarity(df: DataFrame, fields: list[str], order: list, limit: int) -> DataFrame:
    """Rows whose field values are rarest together: by the sum of how often each value occurs.

    The counts are joined from small aggregates, so a frequent value is no hot window."""
    out = df
    for f in fields:
        counts = df.groupBy(f).agg(F.count(F.lit(1)).alias(f"{f}_count"))
        out = out.join(counts.withColumnRenamed(f, f"_{f}"), F.col(f).eqNullSafe(F.col(f"_{f}")), "left").drop(f"_{f}")
    total = sum((F.col(f"{f}_count") for f in fields[1:]), F.col(f"{fields[0]}_count"))
    return out.withColumn("rarity", total).orderBy("rarity", *order).limit(limit)


def waterfill(capacities: Mapping, total: int) -> dict:
    """Fair shares with caps: everyone gets the same until full; what cannot be shared evenly goes by sorted key."""
    out = {k: 0 for k in capacities}
    left = min(total, sum(capacities.values()))
    while left > 0:
        open_ = sorted((k for k in capacities if out[k] < capacities[k]), key=str)
        share = max(1, left // len(open_))
        for k in open_:
            step = min(share, capacities[k] - out[k], left)
            out[k] += step
            left -= step
            if not left:
                break
    return out


def balanced_pick(df: DataFrame, group: str, bucket: str, order: list[str], take: int) -> DataFrame:
    """Per group, rows picked one by one from the bucket that has been picked from least, ties by bucket; a group is a small candidate list.

    Picking round-robin over buckets equals ranking each row within its bucket and taking rows by (rank, bucket)."""
    w = Window.partitionBy(group, bucket).orderBy(*order)
    ranked = df.withColumn("_round", F.row_number().over(w))
    pick = Window.partitionBy(group).orderBy("_round", bucket)
    return ranked.withColumn("pick_order", F.row_number().over(pick)).where(F.col("pick_order") <= take).drop("_round")


def greedy_pick(df: DataFrame, group: str, value: str, order: list[str], quota: int) -> DataFrame:
    """Rows taken in order, skipping a row whose value was just taken, at most `quota` a group.

    A row is taken by such a walk exactly if its value differs from that of the row before it, so no loop is needed.  Null is a value like others."""
    w = Window.partitionBy(group).orderBy(*order)
    seen = df.withColumn("_before", F.lag(value).over(w)).withColumn("_n", F.row_number().over(w))
    changed = seen.where((F.col("_n") == 1) | ~F.col(value).eqNullSafe(F.col("_before")))
    return changed.withColumn("pick_order", F.row_number().over(w)).where(F.col("pick_order") <= quota).drop("_before", "_n")


def set_differences(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """(side, key): keys of only one side."""
    x, y = a.select(key).distinct(), b.select(key).distinct()
    both = x.withColumn("_l", F.lit(True)).join(y.withColumn("_r", F.lit(True)), key, "full")
    return both.where("_l is null or _r is null").select(F.when(F.col("_l").isNull(), "right_only").otherwise("left_only").alias("side"), key)


def slice_union(slices: list[DataFrame], key: str) -> DataFrame:
    """In how many slices each key occurs."""
    out = slices[0].select(key)
    for s in slices[1:]:
        out = out.union(s.select(key))
    return out.groupBy(key).agg(F.count(F.lit(1)).alias("slice_count"))


def authoritative(live: DataFrame, validated: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Live rows, and validated ones that are not live, with a hash of each row."""
    rows = live.select(key, *columns).withColumn("origin", F.lit("live")).unionByName(validated.select(key, *columns).join(live.select(key), key, "left_anti").withColumn("origin", F.lit("validated")))
    return rows.withColumn("row_hash", F.sha2(F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in [key, *columns]]), 256))


def fill_absent(rows: DataFrame, seeds: DataFrame, on: str, columns: list[str]) -> DataFrame:
    """Search rows with absent fields filled from seeds; of seeds with equal keys the least by `columns` counts (nulls first), so no row is repeated."""
    s = seeds.groupBy(on).agg(F.min(F.struct(*columns)).alias("_seed")).select(on, *[F.col(f"_seed.{c}").alias(f"_{c}") for c in columns])
    out = rows.join(s, on, "left")
    return out.select(*[F.coalesce(F.nullif(c, F.lit("")), f"_{c}").alias(c) if c in columns else F.col(c) for c in rows.columns])


def validation_status(seed_date: Column, live_date: Column, live: Column, drift: Column, least: str) -> Column:
    """How a seed row stands against the live one."""
    lo = F.lit(least).cast("date")
    return (
        F.when(~live, "excluded_not_live_validated")
        .when(live_date.isNull(), "excluded_date_missing_or_parse_failed")
        .when(live_date < lo, "excluded_out_of_scope")
        .when(seed_date.isNotNull() & (seed_date != live_date), "date_conflict")
        .when(drift, "validated_live_with_metadata_drift")
        .otherwise("validated_live")
    )


def pages_of(count: int, size: int) -> Iterator[tuple[int, int]]:
    """(page, rows) of a paged request."""
    for page in range(0, max(1, -(-count // size))):
        yield page, min(size, count - page * size)
