"""Lenient readings, review, baselines, report lines and the response cache."""

import math

from pyspark.sql import functions as F

from impactlake.functions import coerce
from impactlake.operators import review
from impactlake.sources import output


def test_readings(spark):
    d = spark.createDataFrame([("12",), (" -3 ",), ("1.5",), (".5",), ("1e3",), ("12d",), ("x",), ("",), (None,), ('["a", 1]',), ("[]",), ("9" * 30,)], "s string")
    got = {r["s"]: (r["l"], tuple(r["m"]), r["f"]) for r in d.select("s", coerce.json_list(F.col("s")).alias("l"), coerce.metric(F.col("s")).alias("m"), coerce.float_value(F.col("s")).alias("f")).collect()}
    assert got['["a", 1]'][0] == ["a", "1"] and all(got[k][0] == [] for k in ("[]", "x", "", None, "12"))
    assert got["12"][1] == (12, None, None) and got[" -3 "][1] == (-3, None, None)
    assert got["1.5"][1] == (None, 1.5, None) and got[".5"][1] == (None, 0.5, None) and got["1e3"][1] == (None, 1000.0, None)
    assert got["12d"][1] == (None, None, "12d") and got["x"][1] == (None, None, "x") and got[None][1] == (None, None, None)
    assert got[""][2] is None and got["12d"][2] is None and math.isclose(got["9" * 30][1][1], 1e30)


def test_review(spark):
    rows = [(1, "testNo", None, "requires_manual_review", "P0"), (2, "vehicleSpeed", "requires_manual_domain_review", "dictionary_candidate", "P2"), (3, "axis", "requires_manual_domain_review", "dictionary_candidate", "P3"), (4, None, None, "conflict_resolution_candidate", None), (5, "axis", None, None, "P0"), (6, "axis", "mapped", "column_candidate", "P0")]
    b = review.backlog(spark.createDataFrame(rows, "i int, target string, decision string, kind string, priority string"), "target", "decision", "kind", "priority")
    assert sorted((r["i"], r["candidate_action"], r["risk"]) for r in b.collect()) == [(1, "raw_only", "high"), (2, "new_column_candidate", "medium"), (3, "new_code_value_candidate", "low"), (4, "defer", "low")]
    assert review.backlog_summary(b).first().asDict() == {"total": 4, "high_risk": 1, "medium_risk": 1, "low_risk": 2, "full_scale_blocked": True}
    assert review.backlog_summary(b.limit(0)).first()["full_scale_blocked"] is False


def test_markdown(spark, tmp_path):
    d = spark.createDataFrame([(2, "a|b"), (1, None)], "n int, s string").orderBy("n")
    assert [r["line"] for r in output.markdown(d, "T").orderBy("line_no").collect()] == ["# T", "", "| n | s |", "| --- | --- |", "| 1 |  |", "| 2 | a\\|b |"]
    output.write_markdown(d, str(tmp_path / "m"), "T")
    assert spark.read.text(str(tmp_path / "m")).count() == 6
    output.write_json(d, str(tmp_path / "j"))
    assert {tuple(r) for r in spark.read.json(str(tmp_path / "j")).select("n", "s").collect()} == {(1, None), (2, "a|b")}


def test_cache(spark):
    cache = spark.createDataFrame([("a", "1"), ("b", "2")], "url string, response string")
    got = output.cached(spark.createDataFrame([("a",), ("a",), ("c",)], "url string"), cache).collect()
    assert sorted((r["url"], r["response"], r["hit"]) for r in got) == [("a", "1", True), ("c", None, False)]
    more = output.remembered(cache, spark.createDataFrame([("a", "9"), ("c", "3")], "url string, response string"))
    assert sorted(map(tuple, more.collect())) == [("a", "1"), ("b", "2"), ("c", "3")]
