"""A field catalog that grows batch by batch: counts, first and last sight, and the first distinct examples in the order of arrival.

What is kept of a field can be merged: sums, least and greatest times, and the `examples` earliest distinct values with when each came first.  The earliest ones of a whole are among
the earliest ones of its parts, so any cut of the observations into batches, in any order, gives the catalog of all of them at once."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..sources.store import Buckets

EXAMPLES = 5


def partial(observed: DataFrame, key: list[str], at: str, examples: int = EXAMPLES) -> DataFrame:
    """The mergeable form of observations (key, at, non_null, example): seen_count, non_null_count, first_seen, last_seen, firsts.

    at: what observations are ordered by, a total order for equal fields."""
    counts = observed.groupBy(*key).agg(F.count(F.lit(1)).alias("seen_count"), F.count_if("non_null").alias("non_null_count"), F.min(at).alias("first_seen"), F.max(at).alias("last_seen"))
    return _with_firsts(counts, observed.where("example is not null").select(*key, F.col(at).alias("_at"), "example"), key, examples)


def merged(partials: DataFrame, key: list[str], examples: int = EXAMPLES) -> DataFrame:
    """Several partial catalogs as one, in the same form."""
    counts = partials.groupBy(*key).agg(F.sum("seen_count").alias("seen_count"), F.sum("non_null_count").alias("non_null_count"), F.min("first_seen").alias("first_seen"), F.max("last_seen").alias("last_seen"))
    return _with_firsts(counts, partials.select(*key, F.explode("firsts").alias("f")).select(*key, F.col("f.at").alias("_at"), F.col("f.example").alias("example")), key, examples)


def _with_firsts(counts: DataFrame, seen: DataFrame, key: list[str], examples: int) -> DataFrame:
    """Each example is counted once before it is ranked, and only the first few are gathered."""
    once = seen.groupBy(*key, "example").agg(F.min("_at").alias("_at"))
    rank = F.row_number().over(Window.partitionBy(*key).orderBy("_at", "example"))
    first = once.withColumn("_n", rank).where(F.col("_n") <= examples).groupBy(*key).agg(F.array_sort(F.collect_list(F.struct(F.col("_at").alias("at"), "example"))).alias("firsts"))
    same = [F.col(f"c.{k}").eqNullSafe(F.col(f"f.{k}")) for k in key]
    none = F.array().cast(first.schema["firsts"].dataType)
    return counts.alias("c").join(first.alias("f"), same, "left").select("c.*", F.coalesce("f.firsts", none).alias("firsts"))


def add(table: Buckets, observed: DataFrame, at: str, batch: int | None = None) -> int:
    """Merge a batch of observations into a stored catalog (in buckets of the field's key); a batch number that was the last one merged is not merged again."""
    if batch is not None and table.note() == batch:
        return table.versions()[-1]
    new = partial(observed, table.key, at)
    return table.change(new.select(*table.key), new, lambda stored: merged(_asked(stored, new, table.key), table.key).unionByName(_others(stored, new, table.key)), batch)


def _asked(stored: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    same = [F.col(f"s.{k}").eqNullSafe(F.col(f"n.{k}")) for k in key]
    return stored.alias("s").join(new.select(*key).alias("n"), same, "left_semi").unionByName(new)


def _others(stored: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    same = [F.col(f"s.{k}").eqNullSafe(F.col(f"n.{k}")) for k in key]
    return stored.alias("s").join(new.select(*key).alias("n"), same, "left_anti")


def examples(catalog: DataFrame) -> DataFrame:
    """The catalog as it is read: examples as an array, in order of arrival."""
    return catalog.withColumn("examples", F.transform("firsts", lambda x: x["example"])).drop("firsts")


def follow(spark: SparkSession, observations: DataFrame, key: list[str], at: str, folder: str, checkpoint: str, buckets: int = 16) -> None:
    """Keep a stored catalog up with a stream of observations: all that is new since the last call."""
    query = observations.writeStream.foreachBatch(lambda batch, number: add(Buckets(batch.sparkSession, folder, key, buckets), batch, at, number)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
