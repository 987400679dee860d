"""Evidence of reports on the star schema: a brand is a subject, its parts are candidates, and orders stand for reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import evidence
from .queries import query, t

DESCRIPTIONS = ["F-150 PU/CC 4WD", "F-150 PU/EC 4X2", "Ranger Super Cab RWD", "Accord 4-DR FWD", "Accord 2 DR Coupe", "Prius 5 HB Hybrid", "Leaf EV 5-DR", "Outback SW AWD w/SAB", "Civic 3-DR Hatch (early release)", "X5 SUV 4-Wheel drive later release", "Mustang Convertible RWD", "plain"]
REPORTS = ["2015 F-150 CREW CAB 4WD TRUCK\nDRIVER side camera AWD view", "final report\n\n2012 HONDA ACCORD SEDAN 4DR FWD\n", "DRIVER AIR BAG PROCEDURE FOR AWD SEDAN", "HYBRID HATCHBACK 5 DOOR\r\nno vehicle", "SUV", "2016 COUPE 2DR, PASSENGER SIDE", "WAGON AWD early release   with side airbag", ""]
one_line = lambda x: x.replace("\r", "' || chr(13) || '").replace("\n", "' || chr(10) || '")
lists = lambda values: "[" + ", ".join(f"'{one_line(v)}'" for v in values) + "]"
PLAIN = "trim(regexp_replace(upper({}), '[^A-Z0-9]+', ' ', 'g'))"


def _shows(u, marks):
    return "(" + " OR ".join(f"contains({chr(39)} {chr(39)} || {u}, '{m[1:]}')" if m[0] == "^" else f"contains(replace({u}, ' ', ''), '{m[1:]}')" if m[0] == "#" else f"contains({u}, '{m}')" for m in marks) + ")"


def _features(u):
    return "list_filter([" + ", ".join(f"CASE WHEN {_shows(u, marks)} THEN '{name}' END" for name, marks in evidence.FEATURES) + "], lambda x: x IS NOT NULL)"


def _against(a, b):
    both = [f"list_intersect({side}, {lists(g)})" for g in evidence.GROUPS for side in (a, b)]
    return " + ".join(f"CASE WHEN len({x}) > 0 AND len({y}) > 0 AND len(list_intersect({x}, {y})) = 0 THEN 1 ELSE 0 END" for x, y in zip(both[::2], both[1::2]))


SCORED = f"""WITH c AS (SELECT p_partkey, p_brand || '/' || p_size AS subject, {PLAIN.format(f"{lists(DESCRIPTIONS)}[CAST(p_partkey % {len(DESCRIPTIONS)} AS INT) + 1]")} AS u FROM part),
    l AS (SELECT DISTINCT p_brand || '/' || p_size AS subject, {PLAIN.format("line")} AS u FROM (SELECT p_brand, p_size, unnest(string_split_regex({lists(REPORTS)}[CAST((p_partkey // 3) % {len(REPORTS)} AS INT) + 1], '[\\r\\n]+')) AS line FROM part WHERE p_partkey % 5 = 0)),
    r AS (SELECT subject, list(DISTINCT f) AS rf FROM (SELECT subject, unnest({_features("u")}) AS f FROM l WHERE length(u) BETWEEN 8 AND 180 AND {_shows("u", evidence.KEYWORDS)} AND (NOT {_shows("u", evidence.NOISE)} OR regexp_matches(u, '\\b(20\\d\\d|19\\d\\d)\\b'))) GROUP BY 1),
    f AS (SELECT c.*, {_features("u")} AS cf, coalesce(rf, []) AS rf FROM c LEFT JOIN r USING (subject)),
    s AS (SELECT p_partkey, subject, len(list_intersect(rf, cf)) AS agreement, {_against("rf", "cf")} AS against, list_sort(cf) AS cf FROM f)"""


@query(SCORED + " SELECT p_partkey, subject, CAST(agreement AS INTEGER) AS agreement, CAST(against AS INTEGER) AS contradictions, CAST(agreement - 3 * against AS INTEGER) AS evidence_score, array_to_string(cf, ',') AS candidate_features FROM s")
def report_features_join(spark, d):
    return scored(spark, d).select("p_partkey", "subject", "agreement", "contradictions", "evidence_score", F.array_join("candidate_features", ",").alias("candidate_features"))


@query(SCORED + """, k AS (SELECT *, agreement - 3 * against AS e, row_number() OVER (PARTITION BY subject ORDER BY agreement - 3 * against DESC, p_partkey) AS n FROM s)
    SELECT a.subject, CASE WHEN a.e >= 1 AND a.e - coalesce(b.e, -999) >= 1 THEN a.p_partkey END AS selected, CAST(a.e AS INTEGER) AS top_score, CAST(coalesce(b.e, -999) AS INTEGER) AS second_score,
      CASE WHEN a.e >= 1 AND a.e - coalesce(b.e, -999) >= 1 THEN 'REPORT_DISAMBIGUATED' ELSE 'REPORT_REVIEW' END AS status FROM (SELECT * FROM k WHERE n = 1) a LEFT JOIN (SELECT * FROM k WHERE n = 2) b ON a.subject = b.subject""")
def report_choice(spark, d):
    return evidence.chosen(scored(spark, d), "subject", "p_partkey", ["p_partkey"])


def scored(spark, d):
    pick = lambda values, at: F.element_at(F.array(*map(F.lit, values)), (at % len(values)).cast("int") + 1)
    p = t(spark, d, "part").select("p_partkey", F.concat_ws("/", "p_brand", F.col("p_size").cast("string")).alias("subject"))
    candidates = p.withColumn("description", pick(DESCRIPTIONS, F.col("p_partkey")))
    reports = p.where("p_partkey % 5 = 0").select("subject", evidence.report_features(pick(REPORTS, F.floor(F.col("p_partkey") / 3))).alias("features"))
    return evidence.weighed(candidates, reports, "subject", "description")
