"""Literal matrices of the scalar functions."""

import datetime

import pytest
from pyspark.sql import functions as F

from impactlake.functions import dates, numbers, presence, ratings, text, vehicles
from impactlake.operators import canonical, linkage, readmodel


def table(spark, values, kind="string"):
    return spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")


def column(spark, values, expr, kind="string"):
    return [r["x"] for r in table(spark, values, kind).select("i", expr(F.col("v")).alias("x")).orderBy("i").collect()]


def test_numbers(spark):
    given = ["1e3", " 12.5 ", "1_000", "1d", "1__0", "_1", "", " ", None, "abc", "-0", "inf", ".5", "5."]
    assert column(spark, given, numbers.number_status) == ["parsed", "parsed", "parsed", "invalid", "invalid", "invalid", "empty", "empty", "null", "invalid", "parsed", "parsed", "parsed", "parsed"]
    got = column(spark, given, numbers.number_value)
    assert got[:4] == [1000.0, 12.5, 1000.0, None] and got[11] == float("inf") and got[12:] == [0.5, 5.0]
    assert column(spark, [1.0, 2.5, None, float("nan")], numbers.number_text, "double") == ["1", "2.5", None, None]


@pytest.mark.parametrize("a,b,same", [("", None, True), ("1", "1.0", True), ("A", "a ", True), ("", "x", False), ("1", "2", False), ("1.0000000001", "1", True)])
def test_values_equal(spark, a, b, same):
    assert spark.createDataFrame([(a, b)], "a string, b string").select(numbers.values_equal(F.col("a"), F.col("b"))).first()[0] is same


def test_ratio_rounds_half_even(spark):
    assert spark.range(1).select(numbers.ratio(F.lit(12345.0), F.lit(100000.0)), numbers.ratio(F.lit(1), F.lit(0))).first() == (0.1234, 0.0)


def test_dates(spark):
    given = ["2016-12-12", "1979", "not-a-date", "", None, "2016-13-01", "20161212"]
    assert column(spark, given, dates.date_status) == ["parsed", "partial", "invalid", "empty", "null", "invalid", "invalid"]
    assert column(spark, ["2016-12-12", "1/2/2015", "2015/3/4", "20150506", "2015-1-2 03:04:05", "x"], dates.any_date) == [datetime.date(2016, 12, 12), datetime.date(2015, 1, 2), datetime.date(2015, 3, 4), datetime.date(2015, 5, 6), datetime.date(2015, 1, 2), None]


def test_presence(spark):
    given = ['{"a": null, "b": 1}', '{"b": 0}', '{"a": ""}', '{"a": "0"}', "{}", '{"a": "x"}']
    v = lambda c: F.parse_json(c)
    assert column(spark, given, lambda c: presence.state(v(c), "a")) == ["null", "missing", "empty", "zero", "missing", "value"]
    assert column(spark, given, lambda c: presence.first_present(v(c), ("a", "b"))) == [None, "0", "", "0", None, "x"]
    assert column(spark, given, lambda c: presence.any_present(v(c), ("a",))) == [True, False, True, True, False, True]


def test_text(spark):
    assert column(spark, ["  a  b\tc ", "", None, " "], text.normalize_text) == ["A B C", None, None, None]
    assert column(spark, ["front - left", "A--B", " x y "], text.family_key) == ["FRONT_LEFT", "A_B", "X_Y"]
    assert column(spark, ["http://h/a/b.PDF?x=1#y", "http://h/", "http://h", "a/b", ".hidden"], text.filename) == ["b.PDF", None, None, "b", ".hidden"]
    assert column(spark, ["http://h/a/b.PDF?x=1", "http://h/b", None], text.extension) == [".pdf", None, None]
    assert column(spark, ["x/y z-w", None], text.code_value) == ["X_Y_Z_W", None]
    assert column(spark, [None, "", " a"], text.semantic_value) == ["<NULL>", "<NULL>", "A"]
    assert column(spark, ["a b/c"], text.quote) == ["a%20b%2Fc"]


def test_locations(spark):
    assert column(spark, ["01", "driver", "Front  Left Seat", "2", "REAR PASSENGER", "unknown", "", "third row"], canonical.location) == ["LEFT_FRONT", "LEFT_FRONT", "LEFT_FRONT", "RIGHT_FRONT", "LEFT_REAR", None, None, "THIRD_ROW"]


def test_assets(spark):
    none = F.lit(None).cast("string")
    urls = ["http://x/a.PDF", "http://x/tdms.zip", "http://x/b.jpg", "http://x/c.mp4", "http://x/uds/1", "http://x/q", None]
    assert column(spark, urls, lambda c: canonical.asset_kind(c, none)) == ["report", "data_package", "photo", "video", "data_package", "other", "other"]
    assert column(spark, urls, lambda c: canonical.asset_subtype(c, none)) == ["PDF", "TDMS", "UNKNOWN", "UNKNOWN", "UDS", "UNKNOWN", "UNKNOWN"]


def test_directions_and_families(spark):
    assert column(spark, [0.0, 45.0, 46.0, 135.0, 225.0, 226.0, 315.0, -10.0, 370.0, None], readmodel.impact_direction, "double") == ["frontal", "frontal", "side", "rear", "rear", "side", "frontal", "frontal", "frontal", "unknown"]
    rest = lambda c: readmodel.family(c, F.lit("frontal"), F.lit("barrier"))
    assert column(spark, ["X FCW", "FCW", "ROLLOVER RESEARCH", "RESEARCH", "PLAIN"], rest) == ["adas_fcw", "frontal_barrier", "rollover", "research_other", "frontal_barrier"]


def test_vehicles(spark):
    assert column(spark, ["1FTFW1ET5DFC10312", "1FTFW1ET5DFC1031X", "1FTFW1ETXXXC10312", "short", None], vehicles.vin_valid) == [True, True, False, False, False]
    assert column(spark, ["Ram", "Ford"], vehicles.make_aliases) == [["RAM", "DODGE"], ["FORD"]]
    got = column(spark, ["F150 SuperCrew 4WD PU", "Sedan AWD Early Release"], vehicles.features)
    assert set(got[0]) == {"4wd", "pickup", "crew_cab"} and set(got[1]) == {"awd", "sedan", "early"}
    both = spark.range(1).select(vehicles.contradictions(F.array(F.lit("awd"), F.lit("suv")), F.array(F.lit("fwd"), F.lit("suv")))).first()[0]
    assert both == ["drive"]
    pairs = [("F-150", "F150", 100), ("F150 SUPERCREW", "F150", 86), ("F150", "FORD F-150", 100), ("RX", "RX350", 76), ("GRAND CHEROKEE", "CHEROKEE GRAND L", 70), ("FOCUS SE WAGON", "WAGON FOCUS", 76), ("X", "X Y", 0), ("X", "Y", 0)]
    for a, b, want in pairs:
        assert spark.createDataFrame([(a, b)], "a string, b string").select(vehicles.model_name_score(F.col("a"), F.col("b"), F.lit("FORD"))).first()[0] == want, (a, b)


def test_authoritative_values(spark):
    cases = {"star": [("0", True, "Not Rated"), ("5", True, "5"), ("9", False, None), ("N/A", False, None)], "tip": [("Tip", True, "Tip"), ("0", True, None), ("maybe", False, None)], "possibility": [("0.2", True, "0.2"), ("0", True, None), ("7", False, None)], "stability": [("1.2", True, "1.2"), ("9", False, None)], "concern": [("fire", True, "fire"), ("3", False, None)], "feature": [("Standard", True, "Standard"), ("eh", False, None)]}
    for kind, rows in cases.items():
        for v, apply, value in rows:
            a, x = ratings.authoritative(kind, F.col("v"))
            r = table(spark, [v]).select(a.alias("a"), x.alias("x")).first()
            assert bool(r["a"]) is apply and (not apply or r["x"] == value), (kind, v)
    assert column(spark, ["0", "4", ""], lambda c: ratings.placeholder("star", c)) == ["Not Rated", "4", None]


def test_confidence(spark):
    cases = [(0, None, None, "UNMATCHED"), (1, 3, None, "HIGH_SINGLE_VARIANT"), (2, 25, 15, "HIGH_DISAMBIGUATED"), (2, 12, 7, "HIGH_DISAMBIGUATED"), (3, 5, 4, "MEDIUM_RANKED"), (3, 5, 5, "REVIEW_AMBIGUOUS_VARIANT"), (2, 0, 0, "REVIEW_AMBIGUOUS_VARIANT")]
    for n, a, b, want in cases:
        assert spark.createDataFrame([(n, a, b)], "n int, a int, b int").select(linkage.confidence_of(F.col("n"), F.col("a"), F.col("b"))).first()[0] == want
