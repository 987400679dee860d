"""Entity merge in closed form: windows instead of a sequential fold."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType


def equivalent(a: Column, b: Column, numeric: bool) -> Column:
    """Columns of numbers by value, all others by text: the text "01" is not "1"."""
    return a.cast("double") == b.cast("double") if numeric else a.cast("string") == b.cast("string")


def _ordered(rows: DataFrame, key: list[str], order: list[str], priority: str) -> DataFrame:
    """Rows with _n, their place in the entity, and _p1, the priority of the entity's first row."""
    w = Window.partitionBy(*key).orderBy(*order)
    return rows.withColumn("_n", F.row_number().over(w)).withColumn("_p1", F.first(priority).over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))


def _value(v: str, w, priority: str) -> Column:
    """Value of a column after the rows of the frame: the last of rows that override the first, else the first that is not null."""
    over = F.last(F.when(F.col(priority) < F.col("_p1"), F.col(v)), ignorenulls=True).over(w)
    return F.coalesce(over, F.first(v, ignorenulls=True).over(w))


def fold(rows: DataFrame, key: list[str], values: list[str], order: list[str], priority: str) -> DataFrame:
    """One row an entity: per column the first non-null value, unless a row of lower priority number than the first one overrides it."""
    w = Window.partitionBy(*key).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    out = _ordered(rows, key, order, priority).select(*key, "_n", *[_value(v, w, priority).alias(v) for v in values], F.count(F.lit(1)).over(w).alias("source_rows"))
    return out.where("_n = 1").drop("_n")


def conflicts(rows: DataFrame, key: list[str], values: list[str], order: list[str], priority: str, source: str) -> DataFrame:
    """Where an incoming value differs from the value so far: one row a key, column and source pair, the first."""
    w = Window.partitionBy(*key).orderBy(*order)
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    all_ = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    base = _ordered(rows, key, order, priority).withColumn("_s1", F.first(source).over(all_))
    now = base.select(*key, "_n", "_s1", source, *values, *[_value(v, before, priority).alias(f"_v{i}") for i, v in enumerate(values)])
    cells = [
        F.struct(F.lit(v).alias("field"), F.col(f"_v{i}").cast("string").alias("current"), F.col(v).cast("string").alias("incoming"), equivalent(F.col(f"_v{i}"), F.col(v), isinstance(rows.schema[v].dataType, NumericType)).alias("_same"))
        for i, v in enumerate(values)
    ]
    each = now.select(*key, "_n", F.col("_s1").alias("source_a"), F.col(source).alias("source_b"), F.explode(F.array(*cells)).alias("c")).select(*key, "_n", "source_a", "source_b", "c.*")
    found = each.where(F.col("current").isNotNull() & F.col("incoming").isNotNull() & ~F.col("_same"))
    first = Window.partitionBy(*key, "field", "source_a", "source_b").orderBy("_n")
    return found.withColumn("_r", F.row_number().over(first)).where("_r = 1").drop("_r", "_n", "_same")


def row_sources(rows: DataFrame, key: list[str], lineage: list[str]) -> DataFrame:
    """Which source rows stand behind each entity, once each."""
    return rows.select(*key, *lineage).distinct()


def entity_keys(rows: DataFrame, primary: list[str], fallback: list[str], order: list[str]) -> DataFrame:
    """Adds entity_key.  Rows with all of `primary` go by it; others by the earliest entity with an equal fallback, else by the fallback itself."""
    whole = F.lit(True)
    for c in primary:
        whole = whole & F.col(c).isNotNull()
    digest = lambda kind, names: F.sha2(F.concat_ws("|", F.lit(kind), *[F.coalesce(F.col(c).cast("string"), F.lit("<NULL>")) for c in names]), 256)
    by_key = rows.withColumn("_pk", F.when(whole, digest("p", primary))).withColumn("_fb", digest("f", fallback))
    # an aggregate, counted in advance on each side of the shuffle: a fallback that most rows share is no hot task
    known = by_key.where(whole).groupBy("_fb").agg(F.min_by("_pk", F.struct(*order)).alias("_first"))
    return by_key.join(known, "_fb", "left").withColumn("entity_key", F.coalesce("_pk", "_first", "_fb")).drop("_pk", "_fb", "_first")


def link(children: DataFrame, parents: DataFrame, keys: list[tuple[str, str]], parent_id: str, out: str) -> DataFrame:
    """The id of the parent by the first of several keys that finds one: (child column, parent column) besides test_no and vehicle_no (null-safe)."""
    found = []
    rows = children
    for i, (c, p) in enumerate(keys):
        w = parents.where(F.col(p).isNotNull()).groupBy(F.col("test_no").alias("_t"), F.col("vehicle_no").alias("_v"), F.col(p).alias("_k")).agg(F.min(parent_id).alias(f"_id{i}"))
        rows = rows.join(w, (rows["test_no"] == w["_t"]) & rows["vehicle_no"].eqNullSafe(w["_v"]) & (rows[c] == w["_k"]), "left").drop("_t", "_v", "_k")
        found.append(f"_id{i}")
    return rows.withColumn(out, F.coalesce(*found)).drop(*found)


def restraint_identity(vehicle_no: Column, location: Column) -> Column:
    """What a restraint belongs to: occupant, vehicle or test."""
    return F.when(vehicle_no.isNotNull() & location.isNotNull(), "occupant").when(vehicle_no.isNotNull(), "vehicle").otherwise("test")
