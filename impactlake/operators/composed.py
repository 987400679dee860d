"""Reports of many sections over a few tables: every table is read once, and all of its sections come from one aggregate.

A row is turned into an array of (section, key, filled) for the sections it belongs to; the array is exploded and counted by section and key, in advance on the
near side of the shuffle.  A second, much smaller aggregate sums the keys of a section up: so duplicates, distributions, cardinalities, coverage and violations are the same two steps."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Section:
    """key: what rows are counted by (None: all alike); where: which rows; filled: what counts as filled (None: every row); most: rows a key may have before it is a violation (None: any
    number; 0: each row of the section is one)."""

    key: Column | None = None
    where: Column | None = None
    filled: Column | None = None
    most: int | None = None


def key_counts(df: DataFrame, sections: Mapping[str, Section]) -> DataFrame:
    """section, key, n and filled of all sections of a table, by one scan; null keys are <NULL>."""
    yes = F.lit(True)
    cells = [
        F.when(
            F.coalesce(s.where, F.lit(False)) if s.where is not None else yes,
            F.struct(F.lit(name).alias("section"), F.coalesce(s.key.cast("string"), F.lit("<NULL>")).alias("key") if s.key is not None else F.lit("").alias("key"), (F.coalesce(s.filled, F.lit(False)) if s.filled is not None else yes).alias("filled")),
        )
        for name, s in sections.items()
    ]
    each = df.select(F.explode(F.array_compact(F.array(*cells))).alias("c"))
    return each.groupBy(F.col("c.section").alias("section"), F.col("c.key").alias("key")).agg(F.count(F.lit(1)).alias("n"), F.count_if("c.filled").alias("filled"))


def report(tables: Mapping[str, tuple[DataFrame, Mapping[str, Section]]]) -> DataFrame:
    """table_name, section, row_count, filled_count, key_count, repeated_keys, surplus_rows, most_rows, commonest_key, violations and status (pass, fail or info) of all sections.

    Sections without a row have zeros.  commonest_key: of the keys with most rows the least."""
    limits = [(t, name, s.most) for t, (_, sections) in tables.items() for name, s in sections.items()]
    counts = None
    for table, (df, sections) in tables.items():
        one = key_counts(df, sections).withColumn("table_name", F.lit(table))
        counts = one if counts is None else counts.unionByName(one)
    known = counts.sparkSession.createDataFrame(limits, "table_name string, section string, most long")  # a row a section
    n = F.col("n")
    over = F.when(F.col("most").isNull(), 0).when(F.col("most") == 0, n).otherwise(F.when(n > F.col("most"), 1).otherwise(0))
    by = counts.join(F.broadcast(known), ["table_name", "section"]).groupBy("table_name", "section").agg(
        F.sum("n").alias("row_count"), F.sum("filled").alias("filled_count"), F.count(F.lit(1)).alias("key_count"), F.count_if(n > 1).alias("repeated_keys"), F.sum(n - 1).alias("surplus_rows"),
        F.max("n").alias("most_rows"), F.min_by("key", F.struct(-n, "key")).alias("commonest_key"), F.sum(over).cast("long").alias("violations"),
    )
    out = known.join(by, ["table_name", "section"], "left")
    numbers = ["row_count", "filled_count", "key_count", "repeated_keys", "surplus_rows", "most_rows", "violations"]
    zero = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in numbers]
    status = F.when(F.col("most").isNull(), "info").when(F.coalesce("violations", F.lit(0)) > 0, "fail").otherwise("pass")
    return out.select("table_name", "section", *zero, "commonest_key", status.alias("status"))


def violations(tables: Mapping[str, tuple[DataFrame, Mapping[str, Section]]], each: int = 20) -> DataFrame:
    """The keys behind the failed sections, the worst first, at most `each` a section (a list for readers; the counts are in `report`)."""
    from pyspark.sql import Window

    parts = []
    for table, (df, sections) in tables.items():
        limited = {name: s for name, s in sections.items() if s.most is not None}
        if limited:
            most = F.create_map(*[F.lit(x) for name, s in limited.items() for x in (name, s.most)])
            parts.append(key_counts(df, limited).where(F.col("n") > most[F.col("section")]).select(F.lit(table).alias("table_name"), "section", "key", "n"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    # a part of each section's keys is ranked first, so that a section with many is no hot task
    lot = F.pmod(F.xxhash64("key"), F.lit(64))
    order = [F.desc("n"), "key"]
    near = out.withColumn("_lot", lot).withColumn("_r", F.row_number().over(Window.partitionBy("table_name", "section", "_lot").orderBy(*order))).where(F.col("_r") <= each).drop("_r", "_lot")
    return near.withColumn("place", F.row_number().over(Window.partitionBy("table_name", "section").orderBy(*order))).where(F.col("place") <= each)
