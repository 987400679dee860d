"""JSON and Markdown reports, and a cache of responses by URL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_json(df: DataFrame, path: str) -> None:
    """JSON lines, nested values as they are."""
    df.write.mode("overwrite").json(path)


def markdown(df: DataFrame, title: str, limit: int = 1000) -> DataFrame:
    """line_no and line of a Markdown table of at most `limit` rows, in the order of df; a report is read by people."""
    cells = [F.replace(F.coalesce(F.col(c).cast("string"), F.lit("")), F.lit("|"), F.lit("\\|")) for c in df.columns]
    head = [f"# {title}", "", f"| {' | '.join(df.columns)} |", "|" + " --- |" * len(df.columns)]
    top = df.sparkSession.createDataFrame(list(enumerate(head)), "line_no long, line string")
    body = df.limit(limit).select((F.monotonically_increasing_id() + len(head)).alias("line_no"), F.concat(F.lit("| "), F.concat_ws(" | ", *cells), F.lit(" |")).alias("line"))
    return top.union(body)


def write_markdown(df: DataFrame, path: str, title: str, limit: int = 1000) -> None:
    """The lines of `markdown` as one text file."""
    markdown(df, title, limit).orderBy("line_no").coalesce(1).select("line").write.mode("overwrite").text(path)


def cached(requests: DataFrame, cache: DataFrame, key: str = "url", response: str = "response") -> DataFrame:
    """Requests with the stored response and whether there is one; requests are asked once each, and of several stored responses the least counts (nulls first)."""
    stored = cache.groupBy(key).agg(F.min(F.struct(response)).alias("_r")).select(key, F.col(f"_r.{response}").alias(response), F.lit(True).alias("hit"))
    return requests.select(key).distinct().join(stored, key, "left").withColumn("hit", F.coalesce("hit", F.lit(False)))


def remembered(cache: DataFrame, fetched: DataFrame, key: str = "url") -> DataFrame:
    """The cache with responses that it lacked; what is stored stays, and of several fetched rows the least by their other columns comes in."""
    others = [c for c in cache.columns if c != key]
    one = fetched.groupBy(key).agg(F.min(F.struct(*others)).alias("_r")).select(key, *[F.col(f"_r.{c}").alias(c) for c in others])
    return cache.unionByName(one.join(cache.select(key), key, "left_anti").select(*cache.columns))
