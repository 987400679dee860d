"""Review, baselines, lenient readings, report lines and the response cache on the star schema."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import coerce
from ..operators import review
from ..sources import output
from .queries import query, t

ITEMS = """i AS (SELECT p_partkey, CASE p_partkey % 5 WHEN 0 THEN 'videoURL' WHEN 1 THEN 'vehicleSpeed' ELSE 'axis' END AS target, CASE WHEN p_size % 3 = 0 THEN 'requires_manual_domain_review' END AS decision,
      CASE p_size % 4 WHEN 0 THEN 'conflict_resolution_candidate' WHEN 1 THEN 'dictionary_candidate' WHEN 2 THEN 'column_candidate' ELSE 'alias_map_candidate' END AS kind, 'P' || (p_partkey % 4) AS priority FROM part),
    b AS (SELECT p_partkey, CASE WHEN target = 'videoURL' THEN 'raw_only' WHEN target = 'vehicleSpeed' THEN 'new_column_candidate' WHEN kind = 'dictionary_candidate' THEN 'new_code_value_candidate'
        WHEN kind = 'column_candidate' THEN 'new_column_candidate' WHEN kind = 'alias_map_candidate' THEN 'map_to_existing_column' ELSE 'defer' END AS candidate_action,
      CASE WHEN priority IN ('P0', 'P1') THEN 'high' WHEN priority = 'P2' THEN 'medium' ELSE 'low' END AS risk FROM i WHERE decision IS NOT NULL OR kind = 'conflict_resolution_candidate')"""


def review_rows(spark, d):
    k, s = F.col("p_partkey"), F.col("p_size")
    items = t(spark, d, "part").select(
        "p_partkey",
        F.when(k % 5 == 0, "videoURL").when(k % 5 == 1, "vehicleSpeed").otherwise("axis").alias("target"),
        F.when(s % 3 == 0, "requires_manual_domain_review").alias("decision"),
        F.when(s % 4 == 0, "conflict_resolution_candidate").when(s % 4 == 1, "dictionary_candidate").when(s % 4 == 2, "column_candidate").otherwise("alias_map_candidate").alias("kind"),
        F.concat(F.lit("P"), (k % 4).cast("string")).alias("priority"),
    )
    return review.backlog(items, "target", "decision", "kind", "priority").select("p_partkey", "candidate_action", "risk")


@query(f"WITH {ITEMS} SELECT * FROM b")
def review_backlog(spark, d):
    return review_rows(spark, d)


@query(f"WITH {ITEMS} SELECT count(*) AS total, count(*) FILTER (risk = 'high') AS high_risk, count(*) FILTER (risk = 'medium') AS medium_risk, count(*) FILTER (risk = 'low') AS low_risk, count(*) FILTER (risk = 'high') > 0 AS full_scale_blocked FROM b")
def review_summary(spark, d):
    return review.backlog_summary(review_rows(spark, d))


@query("SELECT count(*) FILTER (o_orderkey % 10 = 0) AS missing_key, count(*) FILTER (o_orderkey % 7 = 0) AS missing_date, count(*) FILTER (o_orderkey % 7 <> 0 AND CAST(o_orderdate AS DATE) < DATE '1996-01-01') AS before_scope FROM orders")
def scope_gate(spark, d):
    k = F.col("o_orderkey")
    rows = t(spark, d, "orders").select(F.when(k % 10 != 0, k).alias("test_no"), F.when(k % 7 != 0, F.col("o_orderdate").cast("date")).alias("test_date"))
    return review.scope_violations(rows, "test_no", "test_date", "1996-01-01")


LEAST = {"region": 5, "nation": 30, "orders": 1000}


@query(" UNION ALL ".join(f"SELECT '{n}' AS table_name, count(*) AS row_count, CAST({k} AS BIGINT) AS least, count(*) >= {k} AS passed, CASE WHEN count(*) >= {k} THEN 'ok' ELSE '{n}: ' || count(*) || ' rows, {k} needed' END AS message FROM {n}" for n, k in LEAST.items()))
def baseline_checks(spark, d):
    return review.baseline({n: t(spark, d, n) for n in LEAST}, LEAST)


@query("""SELECT o_orderkey, CASE WHEN o_orderkey % 4 = 0 THEN 'a,' || o_custkey ELSE '' END AS list, CASE WHEN o_orderkey % 3 = 0 THEN o_custkey END AS whole, CASE WHEN o_orderkey % 3 = 1 THEN o_custkey + 0.5::DOUBLE END AS number,
    CASE WHEN o_orderkey % 3 = 2 THEN o_orderpriority END AS raw FROM orders""")
def lenient_values(spark, d):
    k, c = F.col("o_orderkey"), F.col("o_custkey").cast("string")
    lists = F.when(k % 4 == 0, F.concat(F.lit('["a", '), c, F.lit("]"))).when(k % 4 == 1, "oops").when(k % 4 == 2, '{"a": 1}')
    texts = F.when(k % 3 == 0, F.concat(F.lit(" "), c)).when(k % 3 == 1, F.concat(c, F.lit(".5"))).otherwise(F.col("o_orderpriority"))
    return t(spark, d, "orders").select("o_orderkey", F.array_join(coerce.json_list(lists), ",").alias("list"), coerce.metric(texts).alias("m")).select("o_orderkey", "list", "m.whole", "m.number", "m.raw")


@query("""SELECT * FROM (VALUES (0, '# Nations'), (1, ''), (2, '| r_name | n |'), (3, '| --- | --- |')) h(line_no, line)
    UNION ALL SELECT 3 + row_number() OVER (ORDER BY r_name), '| ' || r_name || ' | ' || n || ' |' FROM (SELECT r_name, count(*) AS n FROM nation JOIN region ON n_regionkey = r_regionkey GROUP BY 1)""")
def report_lines(spark, d):
    by = t(spark, d, "nation").join(t(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey")).groupBy("r_name").agg(F.count(F.lit(1)).alias("n"))
    return output.markdown(by.orderBy("r_name"), "Nations")


@query("""SELECT url, response, response IS NOT NULL AS hit FROM (SELECT DISTINCT url FROM pages) LEFT JOIN (SELECT url, max(page_id) AS response FROM pages WHERE page_id % 2 = 0 GROUP BY 1) USING (url)""")
def response_cache(spark, d):
    p = t(spark, d, "pages").select("page_id", "url")
    return output.cached(p, p.where("page_id % 2 = 0").groupBy("url").agg(F.max("page_id").alias("response")))
