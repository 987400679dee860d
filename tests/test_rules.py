"""Taxonomy, scored rules, seeds, catalogs in batches, descent into payloads, and what the review of earlier rounds found."""

import datetime
import json
import sqlite3

import pytest
from pyspark.sql import functions as F

from impactlake.functions import presence
from impactlake.operators import audit, canonical, descent, details, linkage, planning, scoring, taxonomy
from impactlake.sources import output, seeds, store
from impactlake.streaming import catalog

# --- taxonomy ---------------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("said,named", [("rear impact", "Rear"), (" Sled / Research ", "Sled / Research"), ("sled_research", "Sled / Research"), ("PEDESTRIAN", "PED"), ("airbag / occupant-protection", "Airbag / Occupant Protection"), ("", None), (None, None), ("sideways", None)])
def test_groups_by_any_of_their_names(said, named):
    assert taxonomy.group_named(said) == named


@pytest.mark.parametrize(
    "said,families,categories",
    [
        ("side pole fmvss214", ["SIDE_POLE"], ["SIDE_POLE_NCAP_75DEG_20MPH", "SIDE_POLE_FMVSS214", "SIDE_POLE_FMVSS214_MISCoded_VTB"]),
        ("frontal-oblique-30deg", ["FRONTAL_OBLIQUE_RMDB", "FRONTAL_OBLIQUE_RMDB_EDGE"], []),
        ("REAR_IMPACT", ["REAR_IMPACT"], []),
        (" child  restraint", ["CHILD_RESTRAINT"], []),
    ],
)
def test_selections(said, families, categories):
    assert taxonomy.selection(said) == (families, categories)


def test_families_go_to_their_groups_in_order(spark):
    given = ["frontal", "Side-Pole", "SIDE_MDB_NCAP", "REAR_IMPACT_FMVSS301_MODE", "adas fcw", None, "", "no such"]
    got = spark.createDataFrame([(i, v) for i, v in enumerate(given)], "i int, v string").select("i", taxonomy.group(F.col("v")).alias("g"), taxonomy.label(F.col("v")).alias("l")).orderBy("i").collect()
    assert [x.g for x in got] == ["Frontal", "Side", "Side", "Rear", "ADAS", None, None, None]
    assert [x.l for x in got] == ["frontal", "측면 Pole family", "SIDE_MDB_NCAP", "후방 FMVSS301", "adas fcw", "", "", "no such"]
    assert len(taxonomy.GROUPS) == 12 and len(taxonomy.FAMILIES) == 18 and len(taxonomy.MODES) == 13 and {g for _, g, _ in taxonomy.FAMILIES} == set(taxonomy.GROUPS)
    none = spark.createDataFrame([], "value string, test_count long")
    assert taxonomy.options(none, none).count() == 0
    one = spark.createDataFrame([("SIDE_MDB", 3), ("PEDESTRIAN", 2)], none.schema)
    out = {x.value: x for x in taxonomy.options(one, none).collect()}
    assert [d.value for d in out["Side"].details] == ["SIDE_MDB_NCAP_38_5MPH_MODE", "SIDE_MDB_FMVSS214_MODE", "SIDE_MDB_RESEARCH_OR_OTHER_MODE"] and out["Side"].detail_count == 0  # nothing is counted by category
    assert [(d.value, d.test_count, d.families) for d in out["PED"].details] == [("PEDESTRIAN", 2, ["PEDESTRIAN"])]


# --- scored rules -----------------------------------------------------------------------------------------------------


def test_each_rule_gives_its_weights(spark):
    """A vehicle that only this rule holds for, and a description with all of its tokens."""
    rules = [(kind, *r) for kind, rs in (("body", scoring.BODY_RULES), ("drive", scoring.DRIVE_RULES)) for r in rs]
    rows = []
    for i, (_, when, tokens) in enumerate(rules):
        at = min(when[0].find(c) for c in ":=#-" if c in when[0] and when[0].find(c) > 0)
        rows.append((i, when[0][:at], when[0][at + 1 :].lower(), "x " + " | ".join(t for t, _ in tokens) + " x"))
    df = spark.createDataFrame(rows, "i int, field string, word string, said string")
    known = {f: F.when(F.col("field") == f, F.col("word")) for f in scoring.FIELDS}
    total, why = scoring.score(known, F.col("said"))
    for x in df.select("i", "field", total.alias("n"), why.alias("why")).collect():
        kind, when, tokens = rules[x.i]
        assert {f"{kind}:{t.strip()}+{w}" for t, w in tokens} <= set(x.why), when
        assert x.n >= sum(w for _, w in tokens) - scoring.PENALTY


def test_scores_of_whole_vehicles(spark):
    rows = [
        ("Four Door Sedan", "Accord", "FWD", "ACCORD 4 DR SEDAN FWD", "direct", 10 + 4 + 25 + 4 + 2, ["body:4 DR+10", "body:SEDAN+4", "drive:FWD+25", "model_text+4"]),
        ("4 door sedan", "A4", "", "A4 2 DR COUPE", "vpic_x", -18 + 4 + 3, ["neg:2dr-vs-4dr", "model_text+4"]),
        (None, None, None, None, None, 0, []),
        ("TRUCK", "F-150 SuperCrew", "4x2", "F-150 SUPERCREW PU/CC RWD", "list", 3 + 25 + 12 + 18 + 4, ["body:PU+3", "body:SUPERCREW+25", "body:PU/CC+12", "drive:RWD+18", "model_text+4"]),
    ]
    df = spark.createDataFrame([r[:5] for r in rows], "body string, model string, drive string, said string, how string")
    total, why = scoring.score({"body": F.col("body"), "model": F.col("model"), "drive": F.col("drive")}, F.col("said"), F.coalesce("how", F.lit("")))
    assert [(x.n, x.why) for x in df.select(total.alias("n"), why.alias("why")).collect()] == [r[5:] for r in rows]


def test_model_lists_by_year_and_other_makes(spark):
    subjects = spark.createDataFrame([(1, "Ram", 2012, "1500"), (2, "Chevy", 2012, "Malibu"), (3, "Chevy", 2013, "Malibu"), (4, "VW", 2012, None)], "id int, make string, year int, model string")
    models = spark.createDataFrame([("DODGE", 2012, "1500 CREW"), ("RAM", 2012, "1500"), ("CHEVROLET", 2012, "MALIBU"), ("CHEVROLET", 2012, "MALIBU HYBRID"), ("VOLKSWAGEN", 2012, "GOLF"), *[("CHEVROLET", 2013, f"MALIBU {i:02d}") for i in range(12)]], "make string, year int, api_model string")
    got = [tuple(x) for x in details.model_matches(subjects, models, "id", year="year").orderBy("id", "match_rank").collect()]
    assert got[:2] == [(1, "RAM", "1500", 100, 1), (2, "CHEVROLET", "MALIBU", 100, 1)]
    assert [(x[2], x[3]) for x in got[2:]] == [(f"MALIBU {i:02d}", 76) for i in range(8)]  # of one score, and eight at most


# --- fields -----------------------------------------------------------------------------------------------------------


def test_rest_columns_come_before_identifiers(spark):
    yes, no = F.lit(True), F.lit(False)
    rec = lambda path, **more: audit.recommendation(yes, F.lit(1.0), F.lit(1.0), F.lit(500), F.lit(1.0), **({"mapped": no, "conflict": no, "engineering": no} | more), **audit.field_flags(F.lit(path)))
    row = spark.range(1).select(rec("a.rowId").alias("a"), rec("a.rowId", extra=yes).alias("b"), rec("x.reports").alias("c"), rec("x.vehicleSpeed").alias("d"), rec("x.modelName").alias("e"), rec("scope.x", conflict=yes).alias("f"), rec("q", engineering=yes).alias("g")).head()
    assert list(row) == ["P3:identifier_no_action", "P3:raw_only_no_action", "P3:raw_only_no_action", "P2:numeric_measurement_column_candidate", "P2:facet_candidate", "P0:semantic_key_candidate", "P1:column_candidate"]


def test_impactors_are_of_one_make(spark):
    df = spark.createDataFrame([("NHTSA", "Moving impactor"), ("Nhtsa", "IMPACTOR"), ("FORD", "IMPACTOR"), (None, "IMPACTOR"), ("NHTSA", None)], "make string, model string")
    assert [x[0] for x in df.select(canonical.participant_kind(F.col("make"), F.col("model"))).collect()] == ["impactor_vehicle"] * 2 + ["subject_vehicle"] * 3


# --- found by the review ----------------------------------------------------------------------------------------------


def test_a_row_that_is_found_counts_even_if_it_is_empty(spark):
    csv = spark.createDataFrame([("a", None, "1"), ("b", "B", "2"), ("b", "A", "3")], "k string, x string, y string")
    df = spark.createDataFrame([("A", "b"), ("z", "b"), ("z", "z")], "k string, other string")
    got = {(r.k, r.other): (r.x, r.y) for r in linkage.enrich(df, csv, ["k"], ["other"], ["x", "y"]).collect()}
    assert got == {("A", "b"): (None, "1"), ("z", "b"): ("A", "3"), ("z", "z"): (None, None)}


def test_repeated_seeds_and_responses_repeat_nothing(spark):
    rows = spark.createDataFrame([(1, ""), (1, "own"), (2, None)], "k int, v string")
    many = spark.createDataFrame([(1, "b"), (1, "a"), (2, "c")], "k int, v string")
    assert sorted(tuple(x) for x in planning.fill_absent(rows, many, "k", ["v"]).collect()) == [(1, "a"), (1, "own"), (2, "c")]
    cache = spark.createDataFrame([("u", "2"), ("u", "1")], "url string, response string")
    assert [tuple(x) for x in output.cached(cache.select("url"), cache).collect()] == [("u", "1", True)]
    more = output.remembered(cache.limit(0), spark.createDataFrame([("w", "9"), ("w", "8")], "url string, response string")).collect()
    assert [tuple(x) for x in more] == [("w", "8")]


def test_one_wild_page_number_makes_one_run(spark):
    df = spark.createDataFrame([(1, 0), (1, 3), (1, 2_000_000_000), (2, 1), (3, None)], "k int, p int")
    got = sorted(tuple(x) for x in audit.page_gap_ranges(df, "k", "p", expected=spark.createDataFrame([(9,)], "k int")).collect())
    assert got == [(1, 1, 2), (1, 4, 1_999_999_999), (2, 0, 0), (9, 0, 0)]
    assert audit.page_gaps(df, "k", "p").where("k = 1 and p < 6").count() == 4
    limited = audit.page_gap_ranges(df.where("k < 3"), "k", "p", most=F.lit(5))
    assert sorted(tuple(x) for x in limited.collect()) == [(1, 1, 2), (1, 4, 5), (2, 0, 0), (2, 2, 5)]


# --- descent ----------------------------------------------------------------------------------------------------------


def first(value, no):
    """The first object of that number, before those inside it."""
    if isinstance(value, dict):
        if value.get("no") == no:
            return value
        value = list(value.values())
    if isinstance(value, list):
        for v in value:
            if (hit := first(v, no)) is not None:
                return hit
    return None


def test_descent_equals_a_walk(spark):
    import random

    r = random.Random(3)

    def grown(depth):
        kind = r.random()
        if depth == 0 or kind < 0.25:
            return r.choice([None, 1, "x", '{"no": 1}', "[", True, 1.5, ""])
        if kind < 0.5:
            return [grown(depth - 1) for _ in range(r.randint(0, 3))]
        names = r.sample(["zeta", "a'b", "no", "m", 'q"', "ü", "a.b"], r.randint(0, 4))
        return {k: r.choice([1, 2, "1", None]) if k == "no" else grown(depth - 1) for k in names}

    trees = [grown(6) for _ in range(400)]
    rows = [(i, json.dumps(t, ensure_ascii=i % 2 == 0, indent=i % 3 or None)) for i, t in enumerate(trees)] + [(900, None), (901, "{no json"), (902, "")]
    df = spark.createDataFrame(rows, "id int, body string")
    found = descent.first_object(df, ["id"], "body", lambda v: F.coalesce(presence.get(v, "no", "long"), F.lit(0)) == 1).collect()
    want = {}
    for i, t in enumerate(trees):
        hit = first(t, 1) or first(t, "1")
        if hit is not None:
            a, b = first(t, 1), first(t, "1")
            want[i] = [x for x in (a, b) if x is not None]
    got = {x.id: json.loads(x.node) for x in found}
    assert set(got) == set(want) and len(got) > 50 and all(got[i] in want[i] for i in got)
    assert {x.depth for x in found} >= {0, 1, 2, 3}


# --- catalog in batches ---------------------------------------------------------------------------------------------------


def test_a_catalog_in_batches_equals_one_batch(spark, tmp_path):
    schema = "field string, at long, non_null boolean, example string"
    rows = [(f"f{i % 3}" if i % 11 else None, i, i % 4 != 0, None if i % 4 == 0 else f"v{(i * 7) % 20}") for i in range(300)]
    whole = catalog.examples(catalog.partial(spark.createDataFrame(rows, schema), ["field"], "at"))
    for b, part in enumerate((rows[200:], rows[:90], rows[90:200])):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").json(f"{tmp_path}/in")
        catalog.follow(spark, spark.readStream.schema(schema).json(f"{tmp_path}/in"), ["field"], "at", f"file://{tmp_path}/cat", f"{tmp_path}/ck", 4)
    stored = catalog.examples(store.Buckets(spark, f"file://{tmp_path}/cat", ["field"]).read())
    assert sorted(map(repr, stored.select(*whole.columns).collect())) == sorted(map(repr, whole.collect()))
    assert len(stored.where("field = 'f1'").head().examples) == 5


# --- seeds ------------------------------------------------------------------------------------------------------------


def test_seeds_from_sqlite(spark, tmp_path):
    path = f"{tmp_path}/seeds.db"
    with sqlite3.connect(path) as db:
        db.execute("CREATE TABLE crash_tests (test_no, test_date TEXT, crash_type TEXT, make TEXT, model TEXT, year)")
        db.executemany(
            "INSERT INTO crash_tests VALUES (?, ?, ?, ?, ?, ?)",
            [(1, "2015-03-04", "vehicle  into barrier ", "FORD", "F", 2015), (2, "2009-01-01", None, None, None, None), (3, " ", None, None, None, None), (4, None, None, None, None, None), (5, "6/7/2016", "", "GM", None, "2016"),
             ("x", "2016-01-01", None, None, None, None), (7, "soon", None, None, None, None), (8, "2012-05-06 10:00:00", "POLE", "VW", "G", "?"), (1, "2014-01-01", "OLD", "OLD", None, 1), (9, "2011/02/03", None, None, None, 0)],
        )
    got = {x.test_no: x for x in seeds.seeds(spark, path, "2011-01-01", 3).collect()}
    assert sorted(got) == [1, 5, 8, 9]
    assert got[1].test_date == datetime.date(2015, 3, 4) and got[1].test_configuration_key == "VEHICLE INTO BARRIER" and got[1].vehicle_make == "FORD"
    assert (got[5].test_date, got[5].test_configuration_key, got[5].model_year) == (datetime.date(2016, 6, 7), None, 2016) and got[8].model_year is None and got[9].test_date == datetime.date(2011, 2, 3)


def test_only_wanted_seeds_leave_the_reader(tmp_path):
    from pyspark.sql.datasource import EqualTo, GreaterThanOrEqual

    path = f"{tmp_path}/seeds.db"
    with sqlite3.connect(path) as db:
        db.execute("CREATE TABLE crash_tests (test_no, test_date TEXT, crash_type TEXT, make TEXT, model TEXT, year)")
        db.executemany("INSERT INTO crash_tests VALUES (?, ?, NULL, NULL, NULL, NULL)", [(i, f"{2000 + i}-01-01") for i in range(20)])
    reader = seeds.SeedReader({"path": path, "partitions": "4"})
    other = EqualTo(("vehicle_make",), "X")
    assert list(reader.pushFilters([GreaterThanOrEqual(("test_date",), datetime.date(2015, 1, 1)), other])) == [other]
    parts = reader.partitions()
    assert [(p.first, p.last) for p in parts] == [(1, 5), (6, 10), (11, 15), (16, 20)]
    assert [[r[1] for r in reader.read(p)] for p in parts] == [[], [], [], [15, 16, 17, 18, 19]]


def test_scores_by_steps_equal_scores_by_columns(spark):
    """The table of scores has its normal forms worked out before the rules use them."""
    df = spark.createDataFrame([("four  door sedan", "F-150 Supercrew", "4 DR SEDAN 2-DR F150 SUPERCREW", "direct"), (None, None, None, None), ("pickup", "", " pu/cc pu ", "vpic_x")], "b string, m string, s string, how string")
    known = {"body": F.col("b"), "model": F.col("m")}
    total, why = scoring.score(known, F.col("s"), F.coalesce("how", F.lit("")))
    out = scoring.scored(df, known, F.col("s"), F.coalesce("how", F.lit("")))
    assert out.select("s", "score", "reasons").collect() == df.select("s", total.alias("score"), why.alias("reasons")).collect()
    assert out._jdf.queryExecution().optimizedPlan().toString().count("regexp_replace") == 5
