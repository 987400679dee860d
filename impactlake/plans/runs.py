"""Distributions, waiting times, interrupted runs and the context of requests on the star schema."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import audit, details, ingest, reports
from ..operators.canonical import cascade_sql
from .queries import query, t


@query("""SELECT 'method' AS name, o_orderpriority AS value, count(*) AS n FROM orders GROUP BY 2 UNION ALL SELECT 'confidence', coalesce(CASE WHEN o_orderstatus <> 'P' THEN o_orderstatus END, '<NULL>'), count(*) FROM orders WHERE o_totalprice > 100000 GROUP BY 2
    UNION ALL SELECT 'cohort', CAST(year(CAST(o_orderdate AS DATE)) AS VARCHAR), count(*) FROM orders GROUP BY 2""")
def build_histograms(spark, d):
    """Several histograms of a build by one scan; one of them of some rows only."""
    values = {"method": F.col("o_orderpriority"), "confidence": F.when(F.col("o_orderstatus") != "P", F.col("o_orderstatus")), "cohort": F.year(F.col("o_orderdate").cast("date"))}
    return reports.histograms(t(spark, d, "orders"), values, {"confidence": F.col("o_totalprice") > 100000})


FAMILY_TEXTS = ["Vehicle into barrier", "IMPACTOR INTO VEHICLE", "rollover", " ", "VTP 32", "sled test", "Static", "lane warning"]
TEXT_SQL = "[" + ", ".join(f"'{x}'" for x in FAMILY_TEXTS) + f"][CAST(o_orderkey % {len(FAMILY_TEXTS)} AS INT) + 1]"


@query(f"""WITH m AS (SELECT CAST(year(CAST(o_orderdate AS DATE)) AS VARCHAR) AS y, o_orderstatus AS k, {TEXT_SQL} AS c FROM orders), f AS (SELECT *, ' ' || upper('VTB_' || CASE WHEN c = ' ' THEN '' ELSE ' ' || c END || ' ' || k) AS words FROM m)
    SELECT 'year' AS name, y AS value, count(*) AS n FROM m GROUP BY 2 UNION ALL SELECT 'test_type', k, count(*) FROM m GROUP BY 2 UNION ALL SELECT 'configuration', coalesce(nullif(trim(c), ''), '<NULL>'), count(*) FROM m GROUP BY 2
    UNION ALL SELECT 'family', {cascade_sql("words", details.MANIFEST_FAMILIES, "'unknown_or_other'")}, count(*) FROM f GROUP BY 2""")
def manifest_distributions(spark, d):
    c = F.element_at(F.array(*map(F.lit, FAMILY_TEXTS)), (F.col("o_orderkey") % len(FAMILY_TEXTS)).cast("int") + 1)
    return reports.manifest_distributions(t(spark, d, "orders"), F.year(F.col("o_orderdate").cast("date")), F.col("o_orderstatus"), c, F.lit("VTB_"))


@query("""SELECT request_count, delay_seconds, round_even(request_count * delay_seconds / 3600, 2) AS delay_hours FROM (SELECT CAST(sum(round_even(n * (3891 / 1500::DOUBLE), 0)) AS BIGINT) AS request_count FROM (SELECT event_type, count(*) AS n FROM events GROUP BY 1)),
    (SELECT unnest([0.1, 0.2, 0.5, 1.0])::DOUBLE AS delay_seconds)""")
def runtime_estimates(spark, d):
    counts = t(spark, d, "events").groupBy("event_type").agg(F.count(F.lit(1)).alias("row_count"))
    return audit.runtime(counts, 1500, 3891)


@query("""SELECT o_orderkey FROM orders WHERE o_orderdate >= '2000-01-01' AND o_orderkey % 3 <> 0 AND NOT (o_orderkey % 5 = 2)""")
def resume_after_interruptions(spark, d):
    """Wanted orders, without those done and those of a run that is at work; runs that were interrupted are closed first and hold nothing."""
    o = t(spark, d, "orders").where("o_orderdate >= '2000-01-01'")
    k = F.col("o_orderkey") % 5
    ended = F.when(k == 3, F.to_timestamp(F.lit("2001-01-01 00:00:00")))
    runs = o.where(k.isin(1, 2, 3)).select("o_orderkey", F.when(k == 2, "working").otherwise("started").alias("status"), ended.alias("finished_at"), F.lit(None).cast("string").alias("error_type"), F.lit(None).cast("string").alias("error_message"))
    closed = details.close_stale(runs, F.to_timestamp(F.lit("2002-01-01 00:00:00")), "restart")
    return details.resume(o, o.where("o_orderkey % 3 = 0"), closed, "o_orderkey", (F.col("status") == "interrupted") | F.col("finished_at").isNotNull())


@query("""SELECT event_id, CASE WHEN event_id % 4 = 0 THEN 'own' WHEN event_id % 4 = 1 THEN NULL WHEN event_type = 'click' THEN CAST(user_id AS VARCHAR) END AS vehicle_no, CASE WHEN event_type = 'click' THEN 'seat' END AS occupant_location FROM events""")
def request_context(spark, d):
    """Restraints (clicks) take what they lack from the request; a key that holds null is there."""
    k = F.col("event_id") % 4
    body = F.when(k == 0, '{"VEHNO": "own"}').when(k == 1, '{"vehicleNo": null}').otherwise("{}")
    endpoint = F.when(F.col("event_type") == "click", "restraint_info").otherwise("occupant_info")
    rows = t(spark, d, "events").select("event_id", endpoint.alias("endpoint_name"), F.parse_json(body).alias("data"), F.col("user_id").alias("request_vehicle_no"), F.lit("seat").alias("request_occupant_location"))
    return ingest.with_request_context(rows).select("event_id", F.col("context_vehicle_no").alias("vehicle_no"), F.col("context_occupant_location").alias("occupant_location"))
