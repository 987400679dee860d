"""Filters by taxonomy, provenance joins, completeness, and output shapes on the star schema."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import ratings, text, vehicles
from ..operators import audit, canonical, details, ingest
from ..sources import files
from .queries import L, lines, order_summary, query, t

GROUPS = {"common": ["STANDARD", "ECONOMY"], "offer": ["PROMO"], "size": ["SMALL", "MEDIUM", "LARGE"]}
ALIASES = {"COMMON_GOODS": "common", "OFFERS": "offer", "SIZED": "size"}


def families_of(group: str) -> list[str]:
    """Members of a group by its name or an alias, however it is written."""
    key = "_".join(group.upper().replace("-", " ").split())
    return GROUPS.get(ALIASES.get(key, key.lower()), [])


@query("SELECT p_partkey, p_type FROM part WHERE p_type IN ('STANDARD', 'ECONOMY')")
def family_group_filter(spark, d):
    return t(spark, d, "part").where(F.col("p_type").isin(families_of("common - goods"))).select("p_partkey", "p_type")


@query("SELECT o_orderkey, o_orderpriority FROM orders WHERE o_orderpriority IN ('1-URGENT', '2-HIGH')")
def configuration_whitelist(spark, d):
    return details.whitelisted(t(spark, d, "orders").select("o_orderkey", "o_orderpriority"), "o_orderpriority", ["1_URGENT", "2_HIGH"])


@query("""SELECT v.field, count(*) AS n FROM (SELECT 'star' AS field FROM part WHERE p_size BETWEEN 0 AND 5 UNION ALL SELECT 'possibility' FROM part WHERE p_retailprice / 1000 < 1.0::DOUBLE AND p_retailprice > 0
    UNION ALL SELECT 'stability' FROM part WHERE p_retailprice / 1000 BETWEEN 0.5::DOUBLE AND 3.0::DOUBLE) v GROUP BY 1""")
def meaningful_values(spark, d):
    p = t(spark, d, "part")
    share = (F.col("p_retailprice") / 1000).cast("string")
    cells = F.array(*[F.struct(F.lit(k).alias("field"), ratings.authoritative(k, c)[0].alias("ok")) for k, c in (("star", F.col("p_size").cast("string")), ("possibility", share), ("stability", share))])
    return p.select(F.explode(cells).alias("c")).where("c.ok").groupBy(F.col("c.field").alias("field")).agg(F.count(F.lit(1)).alias("n"))


@query(f"SELECT DISTINCT o_orderkey FROM orders JOIN ({L}) ON l_orderkey = o_orderkey WHERE p_brand IN ('Brand#1', 'Brand#2', 'Brand#3')")
def evidence_overlap(spark, d):
    o = t(spark, d, "orders").select("o_orderkey")
    return details.with_child(o, lines(spark, d).withColumnRenamed("l_orderkey", "o_orderkey"), "o_orderkey", F.col("p_brand").isin("Brand#1", "Brand#2", "Brand#3"))


@query("SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem WHERE l_returnflag = 'R' AND l_orderkey IN (SELECT o_orderkey FROM orders WHERE o_orderpriority = '1-URGENT' AND o_orderstatus = 'F')")
def report_assets(spark, d):
    wanted = t(spark, d, "orders").withColumnRenamed("o_orderkey", "l_orderkey")
    assets = t(spark, d, "lineitem").where("l_returnflag = 'R'").select("l_orderkey", "l_linenumber", "l_partkey")
    return details.with_child(assets, wanted, "l_orderkey", F.expr("o_orderpriority = '1-URGENT' and o_orderstatus = 'F'"))


@query("""SELECT o_orderpriority AS endpoint, count(DISTINCT o_orderkey) AS payload_count, count(*) AS observation_count, min(CAST(l_shipdate AS DATE)) AS first_seen, max(CAST(l_shipdate AS DATE)) AS last_seen
    FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1""")
def observation_lookup(spark, d):
    seen = t(spark, d, "lineitem").withColumnRenamed("l_orderkey", "o_orderkey")
    return details.observation_summary(t(spark, d, "orders"), seen, "o_orderkey", "o_orderpriority", F.col("l_shipdate").cast("date"))


@query("""SELECT l_orderkey, l_linenumber, l_suppkey, coalesce(s_name, 'unknown') AS source_name FROM (SELECT DISTINCT l_orderkey, l_linenumber, l_suppkey FROM lineitem) LEFT JOIN (SELECT * FROM supplier WHERE s_acctbal > 0) ON s_suppkey = l_suppkey""")
def source_lookup(spark, d):
    s = t(spark, d, "supplier").where("s_acctbal > 0").select(F.col("s_suppkey").alias("l_suppkey"), "s_name")
    rows = t(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_suppkey").distinct()
    return details.named_sources(rows, s, "l_suppkey", "s_name").select("l_orderkey", "l_linenumber", "l_suppkey", "source_name")


@query("""SELECT field_path, sum(seen)::BIGINT AS seen, sum(filled)::BIGINT AS filled FROM (SELECT event_type || '[*].k' AS field_path, 1 AS seen, CASE WHEN value > 10 THEN 1 ELSE 0 END AS filled FROM events WHERE event_type <> 'view') GROUP BY 1""")
def unmapped_fields(spark, d):
    path = F.concat("event_type", F.lit("["), (F.col("event_id") % 3).cast("string"), F.lit("].k"))
    return details.path_rollup(t(spark, d, "events").where("event_type <> 'view'"), path, F.col("value") > 10)


@query("""SELECT v.status, count(*) AS n, round_even(count(*)::DOUBLE / (SELECT count(*) FROM orders), 4) AS share FROM (SELECT CASE WHEN o_orderstatus = 'P' THEN 'excluded' WHEN o_totalprice > 250000 THEN 'drift' ELSE 'live' END AS status FROM orders) v GROUP BY 1""")
def validation_summary(spark, d):
    status = F.when(F.col("o_orderstatus") == "P", "excluded").when(F.col("o_totalprice") > 250000, "drift").otherwise("live")
    return details.shares(t(spark, d, "orders"), status, "status")


@query("""SELECT o_orderkey, l_linenumber, version FROM (SELECT l_orderkey AS o_orderkey, l_linenumber, 'new' AS version FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F') GROUP BY 1, 2
    UNION ALL SELECT l_orderkey, l_linenumber, 'old' FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F') GROUP BY 1, 2)""")
def rebuild_tests(spark, d):
    size = t(spark, d, "lineitem").count()  # footers only
    rows = details.spread(t(spark, d, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), "l_linenumber"), size, "o_orderkey").distinct()
    again = t(spark, d, "orders").where("o_orderstatus = 'F'")
    return details.rebuild(rows.withColumn("version", F.lit("old")), rows.withColumn("version", F.lit("new")), again, "o_orderkey", size)


@query("SELECT n_nationkey, n_name, CAST(NULL AS VARCHAR) AS note, CAST(NULL AS BIGINT) AS row_count FROM nation")
def schema_upgrade(spark, d):
    return files.add_columns(t(spark, d, "nation").select("n_nationkey", "n_name"), {"note": "string", "row_count": "long", "n_name": "string"})


@query("""SELECT c_custkey, array_to_string(list_filter([CASE WHEN c_acctbal > 5000 THEN 'rich' END, CASE WHEN c_mktsegment = 'BUILDING' THEN 'building' END, CASE WHEN c_nationkey < 5 THEN 'near' END], lambda x: x IS NOT NULL), ',') AS flags FROM customer""")
def metadata_flags(spark, d):
    flags = text.compact(text.flag("rich", F.col("c_acctbal") > 5000), text.flag("building", F.col("c_mktsegment") == "BUILDING"), text.flag("near", F.col("c_nationkey") < 5))
    return t(spark, d, "customer").select("c_custkey", F.array_join(flags, ",").alias("flags"))


@query("""SELECT o_orderkey, CASE n WHEN 0 THEN 'No reference test.' WHEN 1 THEN 'Reference test ' || list || '.' ELSE 'Reference tests ' || list || '.' END AS sentence FROM (
    SELECT o_orderkey, count(l) AS n, string_agg(l, ', ' ORDER BY l) AS list FROM (SELECT DISTINCT o_orderkey, CAST(l_linenumber AS VARCHAR) AS l FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey AND l_linenumber <= 3) GROUP BY 1)""")
def reference_bridge(spark, d):
    few = t(spark, d, "lineitem").where("l_linenumber <= 3").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.array_sort(F.collect_set(F.col("l_linenumber").cast("string"))).alias("refs"))
    o = t(spark, d, "orders").select("o_orderkey").join(few, "o_orderkey", "left")
    return o.select("o_orderkey", details.reference_sentence(F.col("refs")).alias("sentence"))


@query("SELECT event_id, event_type AS identity_make, CAST(json_extract(props, '$.k') AS INTEGER) AS identity_year FROM events")
def find_identity(spark, d):
    """An identity object at any of the bounded depths of a payload."""
    wrapped = F.when(F.col("event_id") % 2 == 0, F.concat(F.lit('{"results":[{"VEHICLE":[{"MAKED":"'), "event_type", F.lit('","YEAR":'), F.get_json_object("props", "$.k"), F.lit("}]}]}"))).otherwise(F.concat(F.lit('{"results":[{"MAKED":"'), "event_type", F.lit('","YEAR":'), F.get_json_object("props", "$.k"), F.lit("}]}")))
    v = F.try_parse_json(wrapped)
    found = details.identity(v, ["$.results[0].VEHICLE[0]", "$.results[0]"], {"identity_make": (("vehicleMake", "MAKED"), "string"), "identity_year": (("modelYear", "YEAR"), "int")})
    return t(spark, d, "events").select("event_id", *found)


@query("""SELECT value, full_count, db_count, status FROM (SELECT coalesce(a.v, b.v) AS value, coalesce(a.n, 0) AS full_count, coalesce(b.n, 0) AS db_count,
      CASE WHEN coalesce(a.n, 0) = 0 THEN 'db_only' WHEN coalesce(b.n, 0) = 0 THEN 'uncovered' WHEN b.n < a.n * 0.1::DOUBLE THEN 'thin' ELSE 'represented' END AS status
      FROM (SELECT p_brand AS v, count(*) AS n FROM part GROUP BY 1) a FULL JOIN (SELECT p_brand AS v, count(*) AS n FROM part WHERE p_size > 45 AND p_type = 'PROMO' GROUP BY 1) b ON a.v = b.v)
    ORDER BY CASE status WHEN 'uncovered' THEN 0 WHEN 'thin' THEN 1 ELSE 2 END, value LIMIT 30""")
def coverage_lines(spark, d):
    p = t(spark, d, "part")
    c = audit.coverage(p.select(F.col("p_brand").alias("value")), p.where("p_size > 45 and p_type = 'PROMO'").select(F.col("p_brand").alias("value")), "value")
    return audit.ordered(c, F.when(F.col("status") == "uncovered", 0).when(F.col("status") == "thin", 1).otherwise(2), "value", limit=30)


@query("""SELECT 'lines' AS endpoint, count(*) AS expected, count(*) FILTER (o_orderkey IN (SELECT l_orderkey FROM lineitem)) AS found, count(*) FILTER (o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)) AS missing FROM orders
    UNION ALL SELECT 'returns', count(*), count(*) FILTER (o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R')), count(*) FILTER (o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R')) FROM orders""")
def endpoint_completeness(spark, d):
    o, li = t(spark, d, "orders"), t(spark, d, "lineitem").withColumnRenamed("l_orderkey", "o_orderkey")
    return details.completeness(o, {"lines": li, "returns": li.where("l_returnflag = 'R'")}, "o_orderkey")


@query("""SELECT p_partkey, array_to_string(list_filter([CASE WHEN regexp_matches(u, '\\bRED\\b') THEN 'red' END, CASE WHEN regexp_matches(u, '\\bRING\\b') THEN 'ring' END], lambda x: x IS NOT NULL), ',') AS said FROM (SELECT p_partkey, upper(p_name) AS u FROM part)""")
def text_features(spark, d):
    u = F.upper("p_name")
    return t(spark, d, "part").select("p_partkey", F.array_join(text.compact(text.flag("red", u.rlike(r"\bRED\b")), text.flag("ring", u.rlike(r"\bRING\b"))), ",").alias("said"))


@query("""SELECT p_partkey, CASE p_size % 4 WHEN 0 THEN true WHEN 1 THEN false WHEN 2 THEN false ELSE false END AS valid FROM part""")
def vin_check(spark, d):
    m = F.col("p_size") % 4
    vin = F.when(m == 0, "1ftfw1et5dfc10312").when(m == 1, "1FTFW1ETXXXC10312").when(m == 2, "1FTFW1").otherwise(F.lit(None))
    return t(spark, d, "part").select("p_partkey", vehicles.vin_valid(vin).alias("valid"))


@query("""SELECT section, count(*) AS row_count, min(path) AS first_path FROM (SELECT event_type AS section, '$.results[' || (event_id % 2) || ']' AS path FROM events UNION ALL SELECT event_type, '$.results[' || (1 - event_id % 2) || ']' FROM events) GROUP BY 1""")
def section_counts(spark, d):
    """Payloads of two results each, exploded with their paths."""
    body = F.concat(F.lit('{"results":['), "props", F.lit(","), "props", F.lit(',"noise"]}'))
    rows = ingest.explode_results(t(spark, d, "events").select(F.col("event_type").alias("endpoint_name"), F.try_parse_json(body).alias("payload")))
    return ingest.section_counts(rows).select("section", "row_count", "first_path")


@query(f"""SELECT o_orderkey, o_orderstatus, p_size_max, kinds FROM (SELECT o_orderkey, o_orderstatus, max(p_size) AS p_size_max, coalesce(string_agg(DISTINCT l_returnflag, ',' ORDER BY l_returnflag), '') AS kinds
    FROM orders LEFT JOIN ({L}) ON l_orderkey = o_orderkey GROUP BY 1, 2)""")
def api_rows(spark, d):
    return order_summary(spark, d).select("o_orderkey", "o_orderstatus", "p_size_max", F.array_join("kinds", ",").alias("kinds"))


@query(f"SELECT l_orderkey, l_linenumber, CASE WHEN contains(lower(p_name), 'ring') THEN 'small' ELSE 'big' END AS location FROM {L}")
def location_rules(spark, d):
    return lines(spark, d).select("l_orderkey", "l_linenumber", canonical.cascade(F.lower("p_name"), [("small", ["ring"])], "big").alias("location"))
