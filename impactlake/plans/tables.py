"""The canonical tables, seats, families and sections on rows made from the star schema: what they read are the operators' own values."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import dates
from ..operators import audit, canonical, details, ingest, readmodel
from .queries import query, t

# an occupant row a line item: some metrics filled, some empty, one null, one of no known code
OCCUPANT = """'{"vehicleNo": ' || l_linenumber || ', "occupantLocation": "DRIVER", "HIC": ' || CAST(l_quantity AS INT) || ', "LBELT": "' || l_partkey || '", "RFEM": null, "HIC15": 9' || CASE WHEN l_suppkey % 2 = 0 THEN ', "TTI": "n/a"' ELSE ', "LFEM": ""' END || '}'"""
VEHICLE = """'{"vehicleNo": ' || l_linenumber || ', "DPD1": ' || CAST(l_quantity AS INT) || ', "PDOF": "' || l_suppkey || '", "VDI": "12FDEW1", "LENCNT": 4' || CASE WHEN l_suppkey % 2 = 0 THEN ', "CRHDST": null' ELSE '' END || '}'"""


def source_rows(spark, d, section: str, body: str):
    """Line items as rows of a section with a JSON object."""
    return t(spark, d, "lineitem").select(F.col("l_orderkey").alias("test_no"), F.lit(section).alias("section"), F.expr(f"parse_json({body})").alias("data"))


def codes(df):
    return df.groupBy("code", "status").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("vehicle_no").alias("vehicles"), F.sum(F.col("value").cast("long")).alias("total"))


def codes_sql(*parts: str) -> str:
    each = " UNION ALL ".join(f"SELECT '{code}' AS code, '{status}' AS status, l_linenumber, {value} AS v FROM lineitem WHERE {where}" for code, status, value, where in parts)
    return f"SELECT code, status, count(*) AS n, count(DISTINCT l_linenumber) AS vehicles, CAST(sum(v) AS BIGINT) AS total FROM ({each}) GROUP BY 1, 2"


@query(codes_sql(("HIC", "parsed", "CAST(l_quantity AS BIGINT)", "true"), ("LBELT", "parsed", "l_partkey", "true"), ("RFEM", "null", "NULL::BIGINT", "true"), ("TTI", "invalid", "NULL::BIGINT", "l_suppkey % 2 = 0"), ("LFEM", "empty", "NULL::BIGINT", "l_suppkey % 2 <> 0")))
def injury_metrics(spark, d):
    return codes(canonical.injuries(source_rows(spark, d, "occupant_info", OCCUPANT)))


@query(codes_sql(("DPD1", "parsed", "CAST(l_quantity AS BIGINT)", "true"), ("PDOF", "parsed", "l_suppkey", "true"), ("VDI", "invalid", "NULL::BIGINT", "true"), ("CRHDST", "null", "NULL::BIGINT", "l_suppkey % 2 = 0")))
def deformation_measurements(spark, d):
    return codes(canonical.deformations(source_rows(spark, d, "vehicle_info", VEHICLE)))


SEATS = ["01", "1", "driver", "Left  Front", "left front seat", "FRONT LEFT", "front left seat", "02", "2", "passenger", "RIGHT FRONT", "right front seat", "Front Right", "front right seat", "03", "3", "right rear", "right rear seat", "rear right",
         "rear right seat", "04", "4", "left rear", "left rear seat", "rear left", "rear left seat", "rear passenger", "unknown", " ", "third row", "05"]
SEAT_SQL = "list_value(" + ", ".join(f"'{s}'" for s in SEATS) + f")[CAST(p_partkey % {len(SEATS)} AS INT) + 1]"


@query(f"""SELECT location, count(*) AS n FROM (SELECT CASE WHEN k < 7 THEN 'LEFT_FRONT' WHEN k < 14 THEN 'RIGHT_FRONT' WHEN k < 20 THEN 'RIGHT_REAR' WHEN k < 27 THEN 'LEFT_REAR'
    WHEN k < 29 THEN NULL WHEN k = 29 THEN 'THIRD_ROW' ELSE '05' END AS location FROM (SELECT p_partkey % {len(SEATS)} AS k FROM part)) GROUP BY 1""")
def seat_location(spark, d):
    seats = F.array(*[F.lit(s) for s in SEATS])
    raw = F.element_at(seats, (F.col("p_partkey") % len(SEATS)).cast("int") + 1)
    return t(spark, d, "part").select(canonical.location(raw).alias("location")).groupBy("location").agg(F.count(F.lit(1)).alias("n"))


# texts of tests and the family each belongs to, "" if direction and counterparty decide
TITLES = [("Forward collision warning research", "adas_fcw"), ("Forward collision test", ""), ("Test of FCW", "adas_fcw"), ("Lane departure warning", "adas_ldw"), ("Lane departure of a car", ""), ("An LDW", "adas_ldw"), ("Traffic jam assist", "adas_other"),
          ("Pedestrian rollover", "pedestrian"), ("Low risk deployment", "low_risk_deployment"), ("Sled with vehicle body", "sled_with_body"), ("Sled without vehicle body", "sled_without_body"), ("Out of position", "static_airbag"), ("Rollover", "rollover"),
          ("FMVSS 213", "child_restraint"), ("Calibration", "calibration"), ("Research", "research_other"), ("NCAP", "")]
ANGLES, KINDS = [0, 90, 180, None], ["barrier", "impactor_vehicle", "vehicle"]


@query(f"""WITH o AS (SELECT o_orderkey, CAST(o_orderkey % {len(TITLES)} AS INT) + 1 AS i, CAST(o_custkey % 4 AS INT) AS a, CAST(o_custkey % 3 AS INT) AS k FROM orders)
    SELECT family, count(*) AS n FROM (SELECT CASE WHEN named <> '' THEN named WHEN a = 0 AND k = 0 THEN 'frontal_barrier' WHEN a = 1 AND k = 1 THEN 'side_impactor' WHEN a = 0 THEN 'frontal' WHEN a = 1 THEN 'side' WHEN a = 2 THEN 'rear' ELSE 'unknown' END AS family
      FROM (SELECT a, k, (list_value({", ".join(f"'{f}'" for _, f in TITLES)}))[i] AS named FROM o)) GROUP BY 1""")
def test_family(spark, d):
    pick = lambda xs, c: F.element_at(F.array(*[F.lit(x) for x in xs]), (F.col(c) % len(xs)).cast("int") + 1)
    o = t(spark, d, "orders").select(pick([x for x, _ in TITLES], "o_orderkey").alias("title"), readmodel.impact_direction(pick(ANGLES, "o_custkey").cast("double")).alias("direction"), pick(KINDS, "o_custkey").alias("other"))
    return o.select(readmodel.family(F.upper("title"), F.col("direction"), F.col("other")).alias("family")).groupBy("family").agg(F.count(F.lit(1)).alias("n"))


SECTIONED = """'{"results": [{"TEST": {"TSTNO": ' || event_id || '}, "VEHICLE": [{"VEHNO": 1}, {"VEHNO": ' || user_id || '}, 7], "PHOTOS": null, "NOTES": [{"a": 1}]}, {"OCCUPANT": [{"OCCLOC": "01"}]}]}'"""


@query("""SELECT section, json_path, count(*) AS n FROM (SELECT 'TEST' AS section, '$.results[0].TEST[0]' AS json_path FROM events UNION ALL SELECT 'VEHICLE', '$.results[0].VEHICLE[0]' FROM events
    UNION ALL SELECT 'VEHICLE', '$.results[0].VEHICLE[1]' FROM events UNION ALL SELECT 'OCCUPANT', '$.results[1].OCCUPANT[0]' FROM events) GROUP BY 1, 2""")
def section_rows(spark, d):
    payloads = t(spark, d, "events").select(F.lit("metadata_export").alias("endpoint_name"), F.expr(f"parse_json({SECTIONED})").alias("payload"))
    return ingest.explode_sections(payloads).groupBy("section", "json_path").agg(F.count(F.lit(1)).alias("n"))


@query("""WITH s AS (SELECT DISTINCT l_orderkey AS k, l_linenumber - 1 AS p FROM lineitem WHERE l_returnflag = 'R'), m AS (SELECT o_orderkey AS k, coalesce(max(p), 0) AS last FROM orders LEFT JOIN s ON k = o_orderkey GROUP BY 1)
    SELECT m.k AS test_no, CAST(x AS INTEGER) AS page_number FROM (SELECT k, unnest(range(0, last + 1)) AS x FROM m) m WHERE NOT EXISTS (SELECT 1 FROM s WHERE s.k = m.k AND s.p = x)""")
def page_gaps_expected(spark, d):
    pages = t(spark, d, "lineitem").where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("test_no"), (F.col("l_linenumber") - 1).alias("page_number"))
    return audit.page_gaps(pages, "test_no", "page_number", expected=t(spark, d, "orders").select(F.col("o_orderkey").alias("test_no")))


@query("SELECT count(*) AS total FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_orderstatus = 'F' AND c_mktsegment = 'BUILDING'")
def list_total(spark, d):
    o = t(spark, d, "orders").join(t(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    return readmodel.list_total(o, {"o_orderstatus": "F", "c_mktsegment": "BUILDING", "o_orderpriority": ""}, {})


MANIFEST = [("Impactor into vehicle", "side_impactor"), ("ITV", "side_impactor"), ("Vehicle into barrier", "frontal_barrier"), ("VTB", "frontal_barrier"), ("Vehicle into pole", "pole"), ("VTP", "pole"), ("Vehicle into vehicle", "vehicle_to_vehicle"),
            ("Sled rollover", "rollover"), ("Sled", "sled"), ("Low risk", "airbag_static_or_low_risk"), ("Lane departure warning", "non_crash_adas"), ("XITV", "unknown_or_other"), ("", "unknown_or_other")]


@query(f"""SELECT family, count(*) AS n FROM (SELECT (list_value({", ".join(f"'{f}'" for _, f in MANIFEST)}))[CAST(o_orderkey % {len(MANIFEST)} AS INT) + 1] AS family FROM orders) GROUP BY 1""")
def manifest_family(spark, d):
    key = F.element_at(F.array(*[F.lit(x) for x, _ in MANIFEST]), (F.col("o_orderkey") % len(MANIFEST)).cast("int") + 1)
    none = F.lit(None).cast("string")
    return t(spark, d, "orders").select(details.manifest_family(key, none, F.lit("")).alias("family")).groupBy("family").agg(F.count(F.lit(1)).alias("n"))


@query("""SELECT l_orderkey, l_linenumber, l_partkey, 'test_id=' || l_orderkey || '|vehicle_scope_key=' || l_linenumber || '|occupant_scope_key=LEFT FRONT|restraint_type_key=BELT|restraint_location_key=DASH ' || (l_suppkey % 5) || '|deployment_status_key=' || l_linestatus
    || '|mount_or_system_key=' || upper(l_returnflag) AS legacy_key FROM lineitem""")
def legacy_restraint_key(spark, d):
    body = """'{"location": " dash  ' || (l_suppkey % 5) || '", "mount": "' || lower(l_returnflag) || '"}'"""
    key = details.legacy_restraint_key(F.col("l_orderkey"), F.col("l_linenumber"), F.lit("left  front"), F.lit("Belt"), F.col("l_linestatus"), F.expr(f"parse_json({body})"))
    return t(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", key.alias("legacy_key"))


@query("SELECT o_orderkey, c_name AS classification_c_name, c_mktsegment AS classification_c_mktsegment, n AS summary_n FROM orders LEFT JOIN (SELECT * FROM customer WHERE c_acctbal > 0) ON c_custkey = o_custkey LEFT JOIN (SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey")
def test_lookups(spark, d):
    o = t(spark, d, "orders").select("o_orderkey", "o_custkey")
    found = o.join(t(spark, d, "customer").where("c_acctbal > 0"), F.col("o_custkey") == F.col("c_custkey")).select("o_orderkey", "c_name", "c_mktsegment")
    counts = t(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count(F.lit(1)).alias("n"))
    return details.with_lookups(o, "o_orderkey", classification=(found, ["c_name", "c_mktsegment"]), summary=(counts, ["n"])).drop("o_custkey")


@query("SELECT count(*) AS n FROM orders WHERE strftime(o_orderdate, '%Y-%m-%d') >= '1997-01-01'")
def iso_text_scope(spark, d):
    iso = F.date_format("o_orderdate", "yyyy-MM-dd")
    return t(spark, d, "orders").where(dates.iso_text_in_scope(iso, "1997-01-01")).agg(F.count(F.lit(1)).alias("n"))
