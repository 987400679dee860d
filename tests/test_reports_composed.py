"""Evidence of reports and reports of many sections."""

import pytest
from pyspark.sql import functions as F

from impactlake.operators import composed, evidence
from impactlake.plans import composed as plans

SF = "/root/testdata/sf0.001"


def one(spark, column):
    return spark.range(1).select(column.alias("x")).head().x


def test_each_mark_shows_its_feature(spark):
    rows = [(i, name, "x " + m.lstrip("^#").strip().lower().replace(" ", "-") + " x") for i, (name, marks) in enumerate(evidence.FEATURES) for m in marks]
    got = spark.createDataFrame(rows, "i int, name string, said string").select("name", "said", evidence.features(F.col("said")).alias("f")).collect()
    assert len(got) == sum(len(m) for _, m in evidence.FEATURES) and all(x.name in x.f for x in got), [x for x in got if x.name not in x.f]
    assert one(spark, evidence.features(F.lit(None).cast("string"))) == [] and one(spark, evidence.features(F.lit("AWD"))) == []  # AWD counts after another word only
    assert one(spark, evidence.features(F.lit("fwd"))) == ["FWD"]


@pytest.mark.parametrize(
    "text,found",
    [
        ("2015 FORD F-150 CREW CAB 4WD TRUCK", ["AWD", "CREW_CAB"]),
        ("DRIVER CAMERA CREW CAB", []),  # about the test
        ("DRIVER SIDE 2015 CREW CAB", ["CREW_CAB"]),  # but names a year
        ("SUV", []),  # too short
        ("SEDAN " + "4DR " * 60, []),  # too long
        ("no vehicle here\n\n  HYBRID   SUV  FWD \r\nend", ["FWD", "HYBRID", "SUV"]),
        ("\n".join(["filler line of text"] * 219 + ["A SEDAN 4DR"]), ["4DR"]),
        ("\n".join(["filler line of text"] * 220 + ["A SEDAN 4DR"]), []),
        (None, []),
    ],
)
def test_lines_of_reports(spark, text, found):
    assert one(spark, evidence.report_features(F.lit(text).cast("string"))) == found


def test_candidates_against_reports(spark):
    c = spark.createDataFrame([(1, "a", "F-150 crew cab 4WD"), (1, "b", "F-150 PU/EC x FWD"), (2, "c", "plain"), (3, "d", "x 4WD SUV"), (3, "e", "x 4WD SUV")], "s int, id string, d string")
    r = spark.createDataFrame([(1, ["AWD"]), (1, ["CREW_CAB", "AWD"]), (3, ["AWD"]), (9, ["SUV"])], "s int, features array<string>")
    w = evidence.weighed(c, r, "s", "d")
    assert {x.id: (x.agreement, x.contradictions, x.evidence_score) for x in w.collect()} == {"a": (2, 0, 2), "b": (0, 2, -6), "c": (0, 0, 0), "d": (1, 0, 1), "e": (1, 0, 1)}
    assert {x.s: (x.selected, x.top_score, x.second_score, x.status) for x in evidence.chosen(w, "s", "id", ["id"]).collect()} == {1: ("a", 2, -6, "REPORT_DISAMBIGUATED"), 2: (None, 0, -999, "REPORT_REVIEW"), 3: (None, 1, 1, "REPORT_REVIEW")}


def test_a_report_reads_each_table_once(spark):
    tables = plans.tables(spark, SF)
    plan = composed.report(tables)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan parquet") == len(tables) == 3 and sum(len(s) for _, s in tables.values()) == 15


def test_sections_of_nulls_and_of_nothing(spark):
    df = spark.createDataFrame([(1, "a"), (1, None), (2, None), (None, "a")], "k int, v string")
    sections = {"k": composed.Section(F.col("k"), filled=F.col("v").isNotNull(), most=1), "none": composed.Section(F.col("k"), F.col("v") == "zzz", most=0), "all": composed.Section(), "null": composed.Section(F.col("v"), F.col("v").isNull(), most=0)}
    got = {x.section: x for x in composed.report({"t": (df, sections)}).collect()}
    assert (got["k"].row_count, got["k"].filled_count, got["k"].key_count, got["k"].violations, got["k"].commonest_key, got["k"].status) == (4, 2, 3, 1, "1", "fail")
    assert (got["none"].row_count, got["none"].status) == (0, "pass") and (got["all"].row_count, got["all"].status) == (4, "info") and (got["null"].violations, got["null"].commonest_key) == (2, "<NULL>")
    assert {(x.section, x.key, x.n) for x in composed.violations({"t": (df, sections)}).collect()} == {("k", "1", 2), ("null", "<NULL>", 2)}
    assert {x.row_count for x in composed.report({"t": (df.limit(0), sections)}).collect()} == {0}
