"""Sharding by a consistent-hash ring with virtual nodes and bounded loads.

Every shard has a number of points on the ring; a key belongs to the arc before the next point.
Rows are counted by arc (at most shards x points counts, whatever the input), the overflow of full
shards is followed clockwise on those counts, and the result - which ranks of an arc go to which
shard - is a small table that the rows are joined with.  With slack 0 the bound of a shard is the
even share, so counts differ by one at most (the law `rows`); with more slack fewer rows move when
the number of shards changes.

A null text has no bytes.  A null doc_id is a key like any other.  Equal keys share an arc and are told
apart by rank, ties by text checksum and size, so repeated rows fill distinct slots; one task ranks the rows of an arc, so
keys should tell rows apart.  An empty table gives no rows.  Other columns are passed through unless they bear the name of an added one.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._common import fresh, read, ship


def ring(shards: int, points: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions of the points, ascending, and the shard of each.  A shard's points do not depend on the others."""
    at = np.array([xxhash.xxh64_intdigest(f"{s}/{p}", 7) for s in range(shards) for p in range(points)], np.uint64)
    shard = np.repeat(np.arange(shards), points)
    order = np.lexsort((shard, at))
    return at[order], shard[order]


def follow(counts: np.ndarray, shard: np.ndarray, shards: int, slack: float) -> list[tuple[int, int, int, int, int]]:
    """(arc, first rank, end rank, shard, first slot) for all rows; counts: rows by arc.

    Round by round every arc offers what is left of it to the next point clockwise; a shard takes
    up to its bound, arcs in ring order.  Bounds: the even share, with slack its multiple."""
    total, arcs = int(counts.sum()), len(counts)
    if slack:
        bound = np.full(shards, math.ceil((1 + slack) * total / shards), np.int64)
    else:
        bound = total // shards + (np.arange(shards) < total % shards)
    filled = np.zeros(shards, np.int64)
    left, done = counts.astype(np.int64), np.zeros(arcs, np.int64)
    out = []
    for step in range(arcs):
        busy = np.flatnonzero(left)
        if not busy.size:
            break
        for arc in busy:
            s = int(shard[(arc + step) % arcs])
            take = min(int(left[arc]), int(bound[s] - filled[s]))
            if take:
                out.append((int(arc), int(done[arc]), int(done[arc]) + take, s, int(filled[s])))
                filled[s] += take
                done[arc] += take
                left[arc] -= take
    return out


def shard(df: DataFrame, key: str = "doc_id", text: str = "text", shards: int = 40, points: int = 64, slack: float = 0.0) -> DataFrame:
    """Adds size, text_crc32, shard and slot to every row (the text itself is left out)."""
    spark = df.sparkSession
    ship(spark)
    at, owner = ring(shards, points)
    arc, mark, rank, lo, hi, first = fresh(df, "_arc", "_hash", "_rank", "_from", "_to", "_slot")

    @F.pandas_udf("int")
    def arc_of(h: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(at, h.to_numpy().astype(np.int64).view(np.uint64), side="left") % len(at)).astype("int32")

    hashed = F.xxhash64(F.col(key).cast("string"))
    counts = np.zeros(len(at), np.int64)
    for row in df.select(arc_of(hashed).alias("arc")).groupBy("arc").count().collect():  # at most shards x points rows
        counts[row["arc"]] = row["count"]
    plan = spark.createDataFrame(follow(counts, owner, shards, slack), f"{arc} int, {lo} long, {hi} long, shard int, {first} long")
    body = F.coalesce(F.col(text), F.lit(""))
    rows = df.select(
        key,
        *[c for c in df.columns if c.lower() not in {key.lower(), text.lower(), "size", "text_crc32", "shard", "slot", "law", "grown_shard"}],
        (F.octet_length(body) + 16).cast("long").alias("size"),
        F.crc32(body).cast("long").alias("text_crc32"),
        hashed.alias(mark),
        arc_of(hashed).alias(arc),
    )
    # rows of one key may only differ in their text: its checksum and size decide, so that a repeated task gives the same ranks
    within = Window.partitionBy(arc).orderBy(F.col(mark).cast("decimal(20,0)"), key, "text_crc32", "size")
    ranked = rows.withColumn(rank, F.row_number().over(within) - 1)
    # the plan has at most (shards x points) + (overflowing arcs x shards) rows, whatever the input: safe to broadcast
    placed = ranked.join(F.broadcast(plan), arc).where((F.col(rank) >= F.col(lo)) & (F.col(rank) < F.col(hi)))
    return placed.withColumn("slot", F.col(first) + F.col(rank) - F.col(lo)).drop(arc, mark, rank, lo, hi, first)


def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in shards 0 to 39, counts at most one apart."""
    placed = shard(read(spark, sf_dir, "documents").select("doc_id", "text"))
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


QUERIES = {"op6_sharding": op6_sharding}
