"""Canonical tables derived again from stored payloads, for some tests, and put into their stored tables."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..sources.registry import priority
from ..sources.store import FEW, Buckets
from . import canonical, ingest, keys

LEAST = "2011-01-01"
TABLES = ("tests", "vehicles", "barriers", "participants", "occupants", "restraints", "channels", "intrusions", "assets", "injuries", "deformations")
REQUEST = ["endpoint_name", "test_no", "url"]


def latest(payloads: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """Of payloads of one request the one that came last."""
    w = Window.partitionBy(*key).orderBy(*[F.desc(c) for c in order])
    return payloads.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def in_scope(rows: DataFrame, least: str = LEAST) -> DataFrame:
    """Exploded rows of tests that are in scope by the dates of all their source rows."""
    dated = canonical.project(rows, "tests", canonical.TESTS)
    inside = canonical.scope_decisions(dated, least).where("status = 'in_scope'").select("test_no")
    # Spark guesses 2 kB for a VARIANT, so beside such rows any number of tests looks small enough for a broadcast
    return rows.join(inside.hint("merge"), "test_no", "left_semi")


def derive(rows: DataFrame, tables: tuple[str, ...] = TABLES, kept: Callable[[DataFrame, str], DataFrame] = lambda df, name: df) -> dict[str, DataFrame]:
    """The canonical tables of exploded rows (test_no, lineage, data), entities merged.

    kept: may write a projected table and read it back, as the merge reads it several times."""
    every = canonical.tables(rows)
    out = {}
    for name in tables:
        out[name] = every[name]
        if spec := keys.SPECS.get(name):
            out[name] = keys.merged(kept(keys.with_parts(every[name], name), name), spec, priority(F.col("endpoint_name")))
    return out


class Catalog:
    """The stored canonical tables below a folder, each in buckets of test_no."""

    def __init__(self, spark: SparkSession, folder: str, buckets: int = 64, tables: tuple[str, ...] = TABLES):
        self.spark, self.folder = spark, folder
        self.tables = {name: Buckets(spark, f"{folder}/{name}", ["test_no"], buckets) for name in tables}

    def read(self, table: str) -> DataFrame:
        return self.tables[table].read()

    def rebuild(self, payloads: DataFrame, again: DataFrame | None = None, least: str = LEAST) -> dict[str, int]:
        """Derive the tests of `again` (test_no; None: all that have payloads) and put their rows in the place of the stored ones.

        payloads: payload_id, endpoint_name, test_no, payload (VARIANT), one a request (see `latest`).  The scope gate comes first: of a test
        whose dates are too early, missing or unreadable no row is left.  Payloads are read once, as exploded rows that are written beside the
        tables (and their test_no alone once more, where all are asked for); so are the tests that are asked for, which every table needs.  Tables are changed one after another, each as a whole; a run that was lost on the way is run again and gives the same rows.
        The version of each table is given."""
        stage = f"{self.folder}/_rows/{uuid.uuid4().hex}"
        (payloads if again is None else again).select("test_no").distinct().write.parquet(f"{stage}-asked")
        asked = self.spark.read.parquet(f"{stage}-asked")
        few = asked.count() <= FEW
        mine = payloads.where("test_no is not null") if again is None else payloads.join(asked if few else asked.hint("merge"), "test_no", "left_semi")
        some = mine.select("payload_id", "endpoint_name", "test_no", "payload")
        ingest.exploded_rows(some).write.parquet(stage)

        def kept(df: DataFrame, name: str) -> DataFrame:
            df.write.parquet(f"{stage}-{name}")
            return self.spark.read.schema(df.schema).parquet(f"{stage}-{name}")

        fresh = derive(in_scope(self.spark.read.parquet(stage), least), tuple(self.tables), kept)
        versions = {name: store.replace(asked, fresh[name]) for name, store in self.tables.items()}
        for name in (stage, f"{stage}-asked", *(f"{stage}-{t}" for t in self.tables)):
            at = self.spark._jvm.org.apache.hadoop.fs.Path(name)
            at.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(at, True)
        return versions
