"""Incremental landing: new payload files as a stream, stored once, observed every time."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.ingest import PAYLOAD_KEY, new_payloads
from ..sources.store import Buckets

SCHEMA = "endpoint_name string, test_no int, url string, fetched_at timestamp, body string"


def incoming(spark: SparkSession, path: str) -> DataFrame:
    """Landed JSON lines as a stream of payloads with their content address."""
    raw = spark.readStream.schema(SCHEMA).json(path)
    return raw.select("*", F.sha2("url", 256).alias("canonical_url_hash"), F.sha2(F.coalesce(F.to_json(F.try_parse_json("body")), F.col("body")), 256).alias("payload_hash"))


def land(spark: SparkSession, source: str, store: str, checkpoint: str, buckets: int = 64) -> None:
    """Takes all files that are new since the last call; a file that comes again adds observations only.

    The keys that are stored already are a table in buckets by URL, of which a batch reads and rewrites only what it touches.  Each batch writes its payloads and
    observations to folders of its own number and the keys last, with that number: a batch that is tried again before that overwrites itself, after that it does nothing."""

    def save(batch: DataFrame, number: int) -> None:
        session = batch.sparkSession
        keys = Buckets(session, f"{store}/keys", ["canonical_url_hash"], buckets)
        if keys.note() == number:
            return
        fresh = new_payloads(batch, keys.of(batch), order=["fetched_at", "url"])
        fresh.write.mode("overwrite").parquet(f"{store}/payloads/batch={number}")
        batch.select(*PAYLOAD_KEY, "test_no", "fetched_at").write.mode("overwrite").parquet(f"{store}/observations/batch={number}")
        keys.upsert(session.read.parquet(f"{store}/payloads/batch={number}").select(*PAYLOAD_KEY), PAYLOAD_KEY, note=number)

    query = incoming(spark, source).writeStream.foreachBatch(save).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
