"""Scans of landed files and small external tables, and their writers."""

from __future__ import annotations

import csv

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.dates import any_date


def landed_payloads(spark: SparkSession, path: str, manifest: DataFrame | None = None) -> DataFrame:
    """One row a JSON file: file, payload (VARIANT), payload_hash; with a manifest (endpoint, test_no, ..., file) its columns too.

    A file that is no JSON has a null payload."""
    text = spark.read.option("wholetext", True).option("recursiveFileLookup", True).option("pathGlobFilter", "*.json").text(path)
    rows = text.select(F.substring_index(F.col("_metadata.file_path"), "/", -1).alias("file"), F.try_parse_json("value").alias("payload"), F.sha2(F.to_json(F.try_parse_json("value")), 256).alias("payload_hash"))
    return rows if manifest is None else manifest.join(rows, "file")


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """test_no and test_date of a manifest CSV; rows without a valid number or date are left out."""
    raw = spark.read.option("header", True).csv(path)
    names = {c.lower(): c for c in raw.columns}
    no = F.trim(F.col(names["test_no"]))
    date = any_date(F.col(names["test_date"])) if "test_date" in names else F.lit(None).cast("date")
    rows = raw.select(F.when(no.rlike(r"^\d+$"), no.try_cast("int")).alias("test_no"), date.alias("test_date"))
    return rows.where("test_no is not null and test_date is not null") if "test_date" in names else rows.where("test_no is not null")


def sniff_separator(head: str) -> str:
    """Comma, tab, pipe or semicolon, by the first lines."""
    try:
        return csv.Sniffer().sniff(head, delimiters=",\t|;").delimiter
    except csv.Error:
        line = head.splitlines()[0] if head else ""
        return max(",\t|;", key=line.count)


def external_csv(spark: SparkSession, path: str) -> DataFrame:
    """A CSV of unknown separator: upper-case trimmed names, squashed cells, row_index in file order, file_sha256."""
    head = "\n".join(r["value"] for r in spark.read.text(path).limit(20).collect())[:8192].lstrip("﻿")
    raw = spark.read.option("header", True).option("sep", sniff_separator(head)).option("multiLine", True).csv(path)
    cells = raw.select(*[F.trim(F.regexp_replace(F.coalesce(F.col(f"`{c}`"), F.lit("")), r"\s+", " ")).alias(c.lstrip("﻿").strip().upper()) for c in raw.columns], F.monotonically_increasing_id().alias("row_index"))
    digest = spark.read.format("binaryFile").load(path).select(F.sha2("content", 256).alias("file_sha256"))
    return cells.crossJoin(F.broadcast(digest.limit(1)))  # one row: the digest of the one file


def overlay(spark: SparkSession, path: str, required: list[str], top_only: bool = False) -> DataFrame:
    """An overlay table; fails early when a column it needs is missing."""
    df = spark.read.parquet(path)
    lacking = sorted(set(required) - set(df.columns))
    if lacking:
        raise ValueError(f"overlay lacks columns: {', '.join(lacking)}")
    return df.where("candidate_rank = 1") if top_only else df


def table_exists(spark: SparkSession, *names: str) -> bool:
    return all(spark.catalog.tableExists(n) for n in names)


def channels(spark: SparkSession, test_no: int, count: int = 634, start: int = 1) -> DataFrame:
    """Synthetic instrumentation channels, for volume tests."""
    kinds = F.array(*map(F.lit, ["ACCELEROMETER", "LOAD CELL", "DISPLACEMENT"]))
    return spark.range(start, start + count).select(
        F.lit(test_no).alias("test_no"),
        F.col("id").cast("int").alias("curve_no"),
        kinds[(F.col("id") % 3).cast("int")].alias("sensor_type"),
        F.concat(F.lit("LOC "), (F.col("id") % 12).cast("string")).alias("sensor_location"),
        F.lit(0).alias("first_point"),
        F.lit(9999).alias("last_point"),
        F.lit(0.0001).alias("time_increment"),
    )


def write_csv(df: DataFrame, path: str, columns: list[str]) -> None:
    """The listed columns with a header; arrays as JSON text."""
    text = [F.to_json(c).alias(c) if isinstance(df.schema[c].dataType, (T.ArrayType, T.MapType, T.StructType)) else F.col(c) for c in columns]
    df.select(*text).write.mode("overwrite").option("header", True).csv(path)


def file_sha256(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").load(path).select(F.col("path"), F.sha2("content", 256).alias("sha256"))


def add_columns(df: DataFrame, columns: dict[str, str]) -> DataFrame:
    """Additive schema upgrade: missing columns come as nulls of the type."""
    return df.select("*", *[F.lit(None).cast(t).alias(c) for c, t in columns.items() if c not in df.columns])
