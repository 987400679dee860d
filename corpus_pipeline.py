"""A corpus pipeline: toxicity, language ID, near-duplicates, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet into the
shared folder and read again as the next stage's docs.  The first three keep the columns of documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from impactlake.llm import language, neardup, packing, toxicity
from impactlake.llm._common import drop, read, written

STAGES = [
    ("toxicity", toxicity.stage),
    ("language", language.stage),
    ("near_duplicates", neardup.stage),
    ("packing", packing.stage),
]

#: Training, minima and packing are not expressible in SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for _, stage in STAGES:
        before, docs = docs, written(stage(spark, docs, sf_dir))
        drop(before)
    return docs
