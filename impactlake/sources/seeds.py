"""Seeds of tests from an SQLite file, as a Spark data source: partitions by ranges of rows, and the least date reaches the reader."""

from __future__ import annotations

import datetime
import sqlite3
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, InputPartition, IsNotNull

from ..functions.text import squash

SCHEMA = "row_no long, test_no int, test_date date, test_date_raw string, test_configuration string, model_year int, vehicle_make string, vehicle_model string"
LAYOUTS = ("%Y-%m-%d %H:%M:%S", "%Y-%m-%d", "%m/%d/%Y", "%Y/%m/%d")


def parsed(text: object) -> datetime.date | None:
    """The first layout that fits."""
    if not isinstance(text, str):
        return None
    for layout in LAYOUTS:
        try:
            return datetime.datetime.strptime(text.strip()[: 19 if "%H" in layout else 10], layout).date()
        except ValueError:
            pass
    return None


def whole(value: object) -> int | None:
    try:
        return int(value) if isinstance(value, int | str) and str(value).strip() else None
    except ValueError:
        return None


@dataclass
class Rows(InputPartition):
    first: int
    last: int


class SeedReader(DataSourceReader):
    """Reads crash_tests(test_no, test_date, crash_type, make, model, year); rows without a number or a date that can be read never leave it."""

    def __init__(self, options: dict):
        self.path, self.parts = options["path"], int(options.get("partitions", 8))
        self.least: datetime.date | None = None

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        for f in filters:
            if f.attribute == ("test_date",) and isinstance(f, GreaterThanOrEqual | GreaterThan | EqualTo) and isinstance(f.value, datetime.date):
                least = f.value + datetime.timedelta(days=isinstance(f, GreaterThan))
                self.least = max(self.least or least, least)
                if isinstance(f, EqualTo):
                    yield f
            elif not (isinstance(f, IsNotNull) and f.attribute in (("test_date",), ("test_no",))):
                yield f

    def _open(self) -> sqlite3.Connection:
        return sqlite3.connect(f"file:{self.path}?mode=ro", uri=True)

    def partitions(self) -> list[InputPartition]:
        with self._open() as db:
            lo, hi = db.execute("SELECT min(rowid), max(rowid) FROM crash_tests").fetchone()
        if lo is None:
            return [Rows(1, 0)]
        step = -(-(hi - lo + 1) // self.parts)
        return [Rows(a, min(a + step - 1, hi)) for a in range(lo, hi + 1, step)]

    def read(self, partition: Rows) -> Iterator[tuple]:
        with self._open() as db:
            asked = "SELECT rowid, test_no, test_date, crash_type, year, make, model FROM crash_tests WHERE rowid BETWEEN ? AND ? AND test_date IS NOT NULL AND trim(test_date) != ''"
            for row, no, date, kind, year, make, model in db.execute(asked, (partition.first, partition.last)):
                number, day = whole(no), parsed(date)
                if number is None or day is None or self.least and day < self.least:
                    continue
                yield row, number, day, date, *(None if v is None else str(v) for v in (kind,)), whole(year), *(None if v is None else str(v) for v in (make, model))


class SeedSource(DataSource):
    """Options: path (a file that all executors see), partitions."""

    @classmethod
    def name(cls) -> str:
        return "seed_sqlite"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> SeedReader:
        return SeedReader(self.options)


def seeds(spark: SparkSession, path: str, least: str, partitions: int = 8) -> DataFrame:
    """One seed a test from `least` on, with the configuration's key; of rows of one test the last by date text, then by place in the file, counts."""
    spark.dataSource.register(SeedSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    rows = spark.read.format("seed_sqlite").option("path", path).option("partitions", partitions).load().where(F.col("test_date") >= F.lit(least).cast("date"))
    columns = [c for c in rows.columns if c not in ("test_no", "row_no")]
    last = rows.groupBy("test_no").agg(F.max_by(F.struct(*columns), F.struct("test_date_raw", "row_no")).alias("s")).select("test_no", "s.*")
    key = F.nullif(squash(F.upper(F.coalesce("test_configuration", F.lit("")))), F.lit(""))
    return last.withColumn("test_configuration_key", key)
