"""Payloads to canonical tables, merge and conflicts, sources and streaming."""

import itertools
import json
import random

import pytest
from pyspark.sql import functions as F

from impactlake.operators import audit, canonical, details, ingest, linkage, merge, planning, readmodel
from impactlake.plans import queries
from impactlake.sources import files, http, registry
from impactlake.streaming import landing


def payloads(spark, rows):
    return spark.createDataFrame([(i, e, t, json.dumps(p)) for i, (e, t, p) in enumerate(rows)], "payload_id int, endpoint_name string, test_no int, body string").select("payload_id", "endpoint_name", "test_no", F.parse_json("body").alias("payload"))


@pytest.fixture(scope="module")
def rows(spark):
    export = {"results": [{"TEST": [{"TSTNO": 1, "TSTDAT": "2016-01-02", "CLSSPD": "56.1"}], "VEHICLE": [{"VEHNO": 1, "MAKED": "FORD", "YEAR": "2015", "DPD1": 0, "DPD2": None}], "OCCUPANT": [{"VEHNO": 1, "OCCLOC": "01", "HIC": 0, "CSI": None}], "PHOTOS": None, "URL": [{"URL": "http://x/r.pdf"}]}]}
    data = [
        ("test_summary", 1, {"results": [{"testNo": 1, "testDate": "2016-01-02", "impactAngle": "0", "testType": "NCAP"}, "noise"]}),
        ("metadata_export", 1, export),
        ("vehicle_info", 1, {"results": [{"vehicleNo": 1, "vehicleMake": "FORD", "modelYear": 2015, "vehicleSpeed": ""}, {"vehicleNo": 2, "vehicleMake": "NHTSA", "vehicleModel": "Deformable Impactor", "modelYear": 0}]}),
        ("occupant_info", 1, {"results": [{"vehicleNo": 1, "occupantLocation": "DRIVER", "HIC": "0", "TTI": None}]}),
        ("vehicle_documents", 1, {"results": [{"udsFiles": "http://x/uds/1", "evFiles": "", "isoFiles": "http://x/iso.zip", "abfFiles": None, "tdmsFiles": "http://x/t.tdms"}]}),
        ("barrier_info", 1, {"results": []}),
        ("restraint_info", 1, {"results": [{"vehicleNo": 1, "occupantLocation": "01", "inflationer": None, "deploymentStatus": "DEPLOYED"}]}),
    ]
    return ingest.exploded_rows(payloads(spark, data)).cache()


def test_exploded_rows(rows):
    got = {(r["endpoint_name"], r["section"], r["json_path"]) for r in rows.select("endpoint_name", "section", "json_path").collect()}
    assert ("test_summary", "test_summary", "$.results[0]") in got and ("metadata_export", "OCCUPANT", "$.results[0].OCCUPANT[0]") in got
    assert not any(p == "$.results[1]" and e == "test_summary" for e, _, p in got)


def test_canonical_tables(rows):
    t = canonical.tables(rows)
    test = t["tests"].collect()
    assert len(test) == 1 and test[0]["test_type"] == "NCAP" and test[0]["impact_angle"] == 0.0 and test[0]["closing_speed_status"] == "null"
    assert {(v["vehicle_no"], v["model_year"], v["speed_status"]) for v in t["vehicles"].collect()} == {(1, 2015, "null"), (1, 2015, "empty"), (2, 0, "null")}
    assert {p["kind"] for p in t["participants"].collect()} == {"subject_vehicle", "impactor_vehicle"}
    assert sorted((i["code"], i["status"]) for i in t["injuries"].collect()) == [("CSI", "null"), ("HIC", "parsed"), ("HIC", "parsed"), ("TTI", "null")]
    assert sorted((i["code"], i["status"]) for i in t["deformations"].collect()) == [("DPD1", "parsed"), ("DPD2", "null")]
    assert sorted((a["kind"], a["subtype"]) for a in t["assets"].collect()) == [("data_package", "ISO"), ("data_package", "TDMS"), ("data_package", "UDS"), ("report", "PDF")]
    assert [r["deployment"] for r in t["restraints"].collect()] == [None]
    assert {o["location"] for o in t["occupants"].collect()} == {"LEFT_FRONT"}


def test_field_catalog(rows):
    cat = {(r["section"], r["field_name"]): r for r in ingest.field_catalog(ingest.field_observations(rows, mapping={"TEST.TSTNO": "test_no"}), ["section", "field_name"]).collect()}
    assert cat["OCCUPANT", "CSI"]["seen_count"] == 1 and cat["OCCUPANT", "CSI"]["non_null_count"] == 0
    assert cat["TEST", "TSTDAT"]["examples"] == '"2016-01-02"'


def simulate(rows):
    """The fold as a loop over the rows of one entity in order: (priority, value)."""
    first, value, found = rows[0][0], None, []
    for p, v in rows:
        if v is None:
            continue
        if value is None:
            value = v
        elif v != value:
            found.append((value, v))
            if p < first:
                value = v
    return value, found


def test_fold_equals_a_loop(spark):
    r = random.Random(5)
    data, want, clash = [], {}, {}
    for e in range(150):
        seq = [(r.randint(0, 3), r.choice([None, "a", "b", "c"])) for _ in range(r.randint(1, 6))]
        for n, (p, v) in enumerate(seq):
            data.append((e, n, p, v))
        # an override also replaces an equal or missing value, so compare final values by the closed rule
        over = [v for p, v in seq if v is not None and p < seq[0][0]]
        want[e] = over[-1] if over else next((v for _, v in seq if v is not None), None)
        clash[e] = simulate(seq)
    d = spark.createDataFrame(data, "e int, n int, p int, v string")
    got = {x["e"]: x["v"] for x in merge.fold(d, ["e"], ["v"], ["n"], "p").collect()}
    assert got == want and all(want[e] == clash[e][0] for e in want)
    found = merge.conflicts(d, ["e"], ["v"], ["n"], "p", "n").collect()
    by = {e: sorted((x["current"], x["incoming"]) for x in g) for e, g in itertools.groupby(sorted(found, key=lambda x: x["e"]), key=lambda x: x["e"])}
    assert by == {e: sorted(c) for e, (_, c) in clash.items() if c}


def test_entity_keys(spark):
    d = spark.createDataFrame([(1, 10, "a"), (2, None, "a"), (3, None, "b"), (4, None, "b"), (5, 11, "a")], "n int, no int, m string")
    got = {x["n"]: x["entity_key"] for x in merge.entity_keys(d, ["no"], ["m"], ["n"]).collect()}
    assert got[1] == got[2] != got[5] and got[3] == got[4] != got[1]


def test_duplicates_and_gaps(spark):
    d = spark.createDataFrame([(1, 1), (1, 1), (1, 4), (2, 1)], "k int, p int")
    assert {(r["k"], r["p"]) for r in audit.page_gaps(d, "k", "p", 1).collect()} == {(1, 2), (1, 3)}
    assert audit.duplicate_summary({"d": (d, ["k", "p"])}).first().asDict() == {"group_count": 1, "duplicate_rows": 2, "table_name": "d"}
    assert audit.contract_violations({"d": d}, {"d": (["k", "x"], []), "e": ([], [])}) == ["d: lacks x", "e: missing"]
    assert audit.contract_violations({"d": d}, {"d": (["k"], ["k", "p"])}) == ["d: k, p repeats"]
    with pytest.raises(ValueError, match="rows"):
        audit.gate(d, {"rows": F.count(F.lit(1)) > 10, "max": F.max("p") == 4})


def test_planning(spark):
    assert planning.waterfill({"a": 1, "b": 5, "c": 5}, 7) == {"a": 1, "b": 3, "c": 3}
    assert sum(planning.waterfill({"a": 1, "b": 2}, 10).values()) == 3
    d = spark.createDataFrame([(i, i % 3) for i in range(30)], "i int, b int")
    got = [r["i"] for r in planning.stratified(d, "b", 2, ["i"], 5, F.col("i") == 29).collect()]
    assert got[0] == 29 and len(got) == 5
    with pytest.raises(ValueError):
        readmodel.list_page(d, {}, {}, ["i"], -1, 5)


def test_summary_keeps_zero_and_empty_lists(spark):
    base = spark.createDataFrame([(1,), (2,)], "k int")
    kids = spark.createDataFrame([(1, 0, "b"), (1, 2015, "a"), (1, None, "")], "k int, y int, m string")
    got = {r["k"]: r for r in readmodel.summary(base, kids, "k", "y", {"makes": "m"}, F.col("m") == "a", "flag").collect()}
    assert (got[1]["y_min"], got[1]["makes"], got[1]["flag"]) == (0, ["a", "b"], True)
    assert (got[2]["y_min"], got[2]["makes"], got[2]["flag"]) == (None, [], False)


def test_upsert_takes_the_last(spark):
    old = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    new = spark.createDataFrame([(2, "x", 1), (2, "y", 2), (3, "z", 1)], "k int, v string, o int")
    assert sorted(map(tuple, linkage.overlay_upsert(old, new, ["k"], "o").collect())) == [(1, "a"), (2, "y"), (3, "z")]


def test_unique_evidence(spark):
    c = spark.createDataFrame([(1, 5), (1, 6), (2, 7), (2, 7)], "s int, id int")
    r = spark.createDataFrame([(1, 5), (2, 7)], "s int, id int")
    assert [tuple(x) for x in linkage.unique_evidence(r, c, "s", "id").collect()] == [(1, 5)]


def test_csv_scan(spark, tmp_path):
    p = tmp_path / "r.csv"
    p.write_text("﻿year | Make |  model\n2015|Ford|F-150   XL\n2016||x\n", encoding="utf-8")
    got = files.external_csv(spark, str(p)).orderBy("row_index").collect()
    assert [(r["YEAR"], r["MAKE"], r["MODEL"]) for r in got] == [("2015", "Ford", "F-150 XL"), ("2016", "", "x")] and len(got[0]["file_sha256"]) == 64
    m = tmp_path / "m.csv"
    m.write_text("test_no,test_date\n1,2015-01-02\nx,2015-01-02\n3,never\n")
    assert [tuple(map(str, r)) for r in files.manifest(spark, str(m)).collect()] == [("1", "2015-01-02")]


def test_landed_files(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"results": [{"testNo": 1}]}')
    (tmp_path / "b.json").write_text("not json")
    m = spark.createDataFrame([("test_summary", 1, "a.json"), ("test_summary", 2, "b.json")], "endpoint_name string, test_no int, file string")
    got = {r["file"]: r["payload_hash"] for r in files.landed_payloads(spark, str(tmp_path), m).collect()}
    assert got["a.json"] and got["b.json"] is None


def test_quota_pick_equals_the_walk(spark):
    """One candidate at a time from the year furthest below its quota, then by date and number."""
    import random

    r = random.Random(2)
    rows = [(i, r.choice([1999, 2000, 2001, 2002]), r.randint(1, 30)) for i in range(80)]
    quota, prior = {1999: 5, 2000: 20, 2001: 9}, {2000: 7, 2002: 3}
    left, counts, want = list(rows), dict(prior), []
    for _ in range(45):
        best = min(left, key=lambda x: (counts.get(x[1], 0) - quota.get(x[1], 0), x[2], x[0]))
        left.remove(best)
        counts[best[1]] = counts.get(best[1], 0) + 1
        want.append(best[0])
    d = spark.createDataFrame(rows, "test_no int, year int, day int")
    assert [x["test_no"] for x in details.quota_pick(d, "year", ["day", "test_no"], quota, prior, 45).collect()] == want


def test_rebuild_and_resume(spark):
    rows = spark.createDataFrame([(1, "old"), (2, "old"), (3, "old")], "test_no int, v string")
    fresh = spark.createDataFrame([(2, "new"), (2, "newer"), (9, "stray")], "test_no int, v string")
    again = spark.createDataFrame([(2,), (3,)], "test_no int")
    assert sorted(map(tuple, details.rebuild(rows, fresh, again, "test_no").collect())) == [(1, "old"), (2, "new"), (2, "newer")]
    runs = spark.createDataFrame([(5, 1), (6, 900)], "test_no int, age int")
    wanted = spark.createDataFrame([(i,) for i in (1, 5, 6, 7, 7)], "test_no int")
    assert sorted(x[0] for x in details.resume(wanted, rows, runs, "test_no", F.col("age") > 600).collect()) == [6, 7]


def test_detail_gathers_all_kinds_at_once(spark, monkeypatch):
    """Repeated tests, null keys and kinds without rows; the parts are as many as the rows ask for."""
    monkeypatch.setattr(details, "PART", 100)
    tests = spark.createDataFrame([(i % 900 if i else None, i) for i in range(1000)], "k long, n long")
    a = spark.range(2000).select((F.col("id") % 1000).alias("k"), (-F.col("id")).alias("x"), F.lit(None).cast("string").alias("y"))
    none = a.where("k < 0").select("k", "x")
    out = details.detail(tests, {"a": (a, ["x", "y"]), "none": (none, ["x"])}, "k")
    got = out.collect()
    assert out.columns == ["k", "n", "a", "none"] and len(got) == 1000 and all(r.none == [] for r in got)
    assert all(r.a == ([] if r.k is None else [(-1000 - r.k, None), (-r.k, None)]) for r in got)
    assert out.groupBy(F.spark_partition_id()).count().count() >= 15
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Aggregate") == 1


def test_rebuild_gives_a_task_few_rows(spark, monkeypatch):
    """The parts are as many as the rows ask for; null keys stay, and repeated ones are replaced once."""
    monkeypatch.setattr(details, "PART", 100)
    rows = details.spread(spark.range(3000).select(F.when(F.col("id") > 0, F.col("id") % 1000).alias("k"), F.lit("old").alias("v")), 3000, "k")
    fresh = rows.withColumn("v", F.lit("new"))
    again = spark.range(5000).select((F.col("id") % 500).alias("k"))
    out = details.rebuild(rows, fresh, again, "k", 3000)
    got = out.groupBy(F.spark_partition_id()).count().collect()
    assert len(got) >= 28 and max(x["count"] for x in got) < 400
    assert {(x.v, x["count"]) for x in out.groupBy("v").count().collect()} == {("old", 1501), ("new", 1499)}
    plain = details.rebuild(rows, fresh, again, "k")
    assert out.exceptAll(plain).count() == plain.exceptAll(out).count() == 0


def test_model_matches(spark):
    subjects = spark.createDataFrame([(1, "FORD", "F150"), (2, "FORD", "ZZZ"), (3, "FORD", "F150")], "id int, make string, model string")
    models = spark.createDataFrame([("FORD", m) for m in ("F-150", "F150", "F150 XL", "FOCUS")] + [("RAM", "F150")] + [("FORD", f"F150 X{i}") for i in range(12)], "make string, api_model string")
    got = sorted((x["id"], x["match_rank"], x["api_model"], x["score"]) for x in details.model_matches(subjects, models, "id").collect())
    assert got == [(i, n, m, 100) for i in (1, 3) for n, m in ((1, "F150"), (2, "F-150"))]
    close = details.model_matches(subjects, models.where("api_model like 'F150 X%'"), "id").where("id = 1")
    assert close.count() == 8 and {x["score"] for x in close.collect()} == {76}


def test_detail_of_tests_without_children(spark):
    tests = spark.createDataFrame([(1,), (2,)], "test_no int")
    kids = spark.createDataFrame([(1, "b", 2), (1, "a", 1), (3, "x", 9)], "test_no int, name string, n int")
    got = {x["test_no"]: [tuple(v) for v in x["kids"]] for x in details.detail(tests, {"kids": (kids, ["name", "n"])}, "test_no").collect()}
    assert got == {1: [("a", 1), ("b", 2)], 2: []}


def test_registry(spark):
    assert registry.endpoints(spark).count() == 21
    url = spark.range(1).select(registry.url_for("occupant_detail", "https://h/", test_no=F.lit(5), vehicle_no=F.lit(1), occupant_location=F.lit("LEFT FRONT"))).first()[0]
    assert url == "https://h/vehicle-database-test-results/get-occupant-detail-information/1/5/LEFT%20FRONT"
    paged = spark.range(1).select(registry.url_for("instrumentation_info", "https://h", test_no=F.lit(5), pageNumber=F.lit(1), count=F.lit(20))).first()[0]
    assert paged == "https://h/vehicle-database-test-results/get-instrumentation-info/5?pageNumber=1&count=20"
    assert registry.BY_NAME["vehicle_documents"].path == "/vehicle-documents/test-no/{test_no}" and registry.BY_NAME["restraint_info"].params == ("test_no", "vehicle_no", "occupant_location")
    assert [e.name for e in registry.ENDPOINTS if e.optional] == ["search_vehicle", "search_barrier", "vehicle_models", "occupant_types", "test_detail"]


def test_http_gate_and_retries():
    import urllib.error

    with pytest.raises(http.LiveAccessDisabled):
        http.HttpReader({"requests": "[]"})
    calls, pauses = [], []

    def opener(url):
        calls.append(url)
        raise urllib.error.HTTPError(url, 503 if len(calls) < 3 else 404, "", {}, None)

    assert http.fetch("http://x", opener=opener, sleep=pauses.append) == (404, None, 3) and pauses == [0.5, 1.0]


def test_streaming_landing_is_idempotent(spark, tmp_path):
    src, store, ck = (str(tmp_path / x) for x in ("src", "store", "ck"))
    (tmp_path / "src").mkdir()
    row = {"endpoint_name": "e", "test_no": 1, "url": "u", "fetched_at": "2024-01-01T00:00:00Z", "body": '{"b": 1, "a": 2}'}
    (tmp_path / "src" / "1.json").write_text(json.dumps(row) + "\n" + json.dumps(row | {"url": "v"}) + "\n")
    landing.land(spark, src, store, ck)
    (tmp_path / "src" / "2.json").write_text(json.dumps(row | {"body": '{"a":2,"b":1}', "fetched_at": "2024-01-02T00:00:00Z"}) + "\n")
    landing.land(spark, src, store, ck)
    landing.land(spark, src, store, ck)
    assert spark.read.parquet(f"{store}/payloads").count() == 2
    assert spark.read.parquet(f"{store}/observations").count() == 3


def test_candidates_by_what_they_share(spark):
    """Pairs met by shared values are those of the whole block, each once: nulls, repeated rows, a hot block, no rows."""
    rng = random.Random(5)
    rows = [(i, rng.choice(["x", "x", "y", None]), rng.choice(["n1", "n2", "n3", None]), rng.choice([1, 2, 3, 6, 20, None])) for i in range(120)]
    p = spark.createDataFrame([*rows, rows[0]], "id int, b string, n string, s int")
    a, b = p.toDF("subject", "b", "an", "asz"), p.toDF("candidate", "b", "bn", "bsz")
    score = F.when(F.col("an") == F.col("bn"), 20).otherwise(0) + F.when(F.abs(F.col("asz") - F.col("bsz")) <= 2, 10).otherwise(0)
    near = F.transform(F.array(*[F.lit(x) for x in (-2, -1, 0, 1, 2, 2)]), lambda x: F.col("asz") + x)
    reach = [(F.array("an"), F.col("bn")), (near, F.col("bsz"))]
    get = lambda x, *r: sorted(map(repr, linkage.candidates(x, b, ["b"], score, 10, ["subject"], ["candidate"], 500, *r).select("subject", "candidate", "score", "candidate_rank").collect()))
    whole = get(a)
    assert len(whole) > 2000 and get(a, reach) == whole
    assert get(a.limit(0), reach) == []


def test_best_candidates_are_those_of_all_pairs(spark):
    """Ranked rows equal those of scoring every pair: nulls, repeated rows, an id with several rows, a hot block, no rows; and few pairs are made."""
    rng = random.Random(6)
    rows = [(i, rng.choice(["x", "x", "x", "y", None]), rng.choice(["n1", "n2", "n3", None]), rng.choice([1, 2, 3, 6, 20, None])) for i in range(150)]
    rows += [rows[0], rows[3], (5, "x", "n1", 2), (5, "x", "n1", 3), (5, "x", "n2", 2), (None, "x", "n1", 2)]
    p = spark.createDataFrame(rows, "id int, b string, n string, s int")
    a, b = p.toDF("subject", "b", "an", "asz"), p.toDF("candidate", "b", "bn", "bsz")
    score = F.when(F.col("an") == F.col("bn"), 20).otherwise(0) + F.when(F.col("asz") == F.col("bsz"), 5).otherwise(0)
    own, size = F.col("asz").cast("string"), F.col("bsz").cast("string")
    ways = [(F.array(F.array("an")), F.array("bn"), 20), (F.array(F.array(own)), F.array(size), 5), (F.array(F.array("an", own)), F.array("bn", size), 25)]
    shown = lambda df: sorted(map(repr, df.select("subject", "candidate", "score", "candidate_rank").collect()))
    for most in (1, 3, 8):
        whole = shown(linkage.candidates(a, b, ["b"], F.when(F.col("subject") != F.col("candidate"), score), 5, ["subject"], ["candidate"], most))
        got = shown(linkage.best_candidates(a, b, ["b"], ways, 5, ["subject"], ["candidate"], most, ["an", "asz"], ("subject", "candidate")))
        assert len(whole) > 90 and got == whole
    assert shown(linkage.best_candidates(a.limit(0), b, ["b"], ways, 5, ["subject"], ["candidate"], 3, ["an", "asz"], ("subject", "candidate"))) == []


def rows_made(df):
    """Rows that each join of a query put out, as counted while it ran."""
    df.collect()
    found, todo = [], [df._jdf.queryExecution().executedPlan()]
    while todo:
        node = todo.pop()
        name = node.nodeName()
        if name == "AdaptiveSparkPlan":
            todo.append(node.executedPlan())
        elif "QueryStage" in name:
            todo.append(node.plan())
        else:
            if "Join" in name:
                found.append(node.longMetric("numOutputRows").value())
            todo += [node.children().apply(i) for i in range(node.children().size())]
    return found


def test_ranked_parts_make_few_pairs(spark, tmp_path):
    """A block of many alike parts costs its rows, not their pairs."""
    spark.range(3000).selectExpr("id AS p_partkey", "'b' AS p_brand", "'t' AS p_type", "'n' AS p_name", "1 AS p_size").write.parquet(str(tmp_path / "part.parquet"))
    assert max(rows_made(queries.candidate_rank(spark, str(tmp_path)))) <= 3000
    assert queries.candidate_rank(spark, str(tmp_path)).count() == 24000


def test_confidence_counts_every_candidate(spark, tmp_path):
    """Candidates past the eighth count too, and a block of many alike parts costs its rows, not their pairs."""
    spark.range(3000).selectExpr("id AS p_partkey", "'b' AS p_brand", "'t' AS p_type", "'n' AS p_name", "IF(id = 0, 2, IF(id < 2000, 1, 40)) AS p_size").write.parquet(str(tmp_path / "part.parquet"))
    out = queries.confidence(spark, str(tmp_path))
    assert max(rows_made(out)) <= 3000
    assert {(x.subject == 0, x.candidate_count, x.top_score, x.second_score, x.confidence) for x in out.collect()} == {(True, 2999, 30, 30, "REVIEW_AMBIGUOUS_VARIANT"), (False, 2999, 35, 35, "REVIEW_AMBIGUOUS_VARIANT")}


def test_score_counts_are_those_of_all_pairs(spark):
    """Counts by score equal those of scoring every pair: nulls, repeated rows, an id with several rows, a hot block, scores that come out equal, no rows."""
    rng = random.Random(7)
    rows = [(i, rng.choice(["x", "x", "x", "y", None]), rng.choice(["n1", "n2", "n3", None]), rng.choice([1, 2, 3, 6, 20, 2**31 - 1, None])) for i in range(150)]
    rows += [rows[0], rows[3], (5, "x", "n1", 2), (5, "x", "n1", 3), (5, "x", "n2", 2), (None, "x", "n1", 2), (900, "z", "n1", 1), (901, "z", "n1", 4), (902, "w", "n1", 1)]
    p = spark.createDataFrame(rows, "id int, b string, n string, s int")
    a, b = p.toDF("subject", "b", "an", "asz"), p.toDF("candidate", "b", "bn", "bsz")
    gap = F.abs(F.col("asz").cast("long") - F.col("bsz"))
    shown = lambda df: sorted(map(repr, df.collect()))
    for whole, steps, least in ((20, [(0, 15), (2, 10)], 15), (5, [(1, 10), (4, 5)], 5)):
        points = F.lit(0)
        for r, n in reversed(steps):
            points = F.when(gap <= r, n).otherwise(points)
        score = F.when(F.col("an") == F.col("bn"), whole).otherwise(0) + points
        pairs = linkage.candidates(a, b, ["b"], F.when(F.col("subject") != F.col("candidate"), score), least, ["subject"], ["candidate"], 10**6)
        counts = linkage.score_counts(a, b, ["b"], ("an", "bn", whole), ("asz", "bsz", steps), least, ("subject", "candidate"))
        assert pairs.count() > 1000
        assert shown(counts.select("subject", F.inline("_scores"))) == shown(pairs.groupBy("subject", "score").agg(F.count(F.lit(1)).alias("candidates")))
        assert shown(linkage.confidence_of_counts(counts, "subject")) == shown(linkage.confidence(pairs, "subject"))
    assert shown(linkage.score_counts(a.limit(0), b, ["b"], ("an", "bn", 20), ("asz", "bsz", [(0, 15)]), 5, ("subject", "candidate"))) == []


def test_equivalence_and_metrics_read_ranked_rows_once_each(spark):
    rows = [(1, "s", 20, 1), (1, "s", 20, 2), (1, "t", 10, 3), (2, "u", 10, 1), (2, "u", 9, 2), (3, None, 5, 1), (3, "v", 5, 2), (4, "w", 5, 1)]
    r = spark.createDataFrame(rows, "subject int, signature string, score int, candidate_rank int")
    base = linkage.confidence(r, "subject")
    out = linkage.equivalence(r, "subject", "signature", "score", base)
    assert {x.subject: x.confidence for x in out.collect()} == {1: "HIGH_TOP_EQUIVALENT_RATING", 2: "HIGH_EQUIVALENT_RATING", 3: "REVIEW_AMBIGUOUS_VARIANT", 4: "HIGH_SINGLE_VARIANT"}
    assert len(rows_made(out)) == 1
    told = r.join(out.select("subject", linkage.selection_status(F.col("confidence")).alias("selection_status")), "subject")
    got = linkage.overlay_metrics(told.unionByName(spark.createDataFrame([(None, "s", 5, 1, "auto")], told.schema)), "subject")
    assert tuple(got.collect()[0]) == (9, 4, 3, 1) and "Expand" not in got._jdf.queryExecution().optimizedPlan().toString()
    assert tuple(linkage.overlay_metrics(told.limit(0), "subject").collect()[0]) == (0, 0, 0, 0)


def test_each_code_is_looked_up_once(spark):
    rows = spark.createDataFrame([(1, '{"HIC": "7"}'), (2, '{"HIC": null}'), (3, '{"x": 1}'), (4, "[1]")], "test_no int, body string").select("test_no", F.parse_json("body").alias("data"))
    out = canonical.present_codes(rows, ["HIC"], [F.col("test_no")])
    assert sorted(map(tuple, out.collect())) == [(1, "HIC", "7", 7.0, "parsed"), (2, "HIC", None, None, "null")]
    assert out._jdf.queryExecution().analyzed().toString().count("$['HIC']") == 1
