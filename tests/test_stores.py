"""Page walks, stored tables, rebuilds and entity keys against walks in plain Python."""

import http.server
import json
import random
import threading
import urllib.error
from io import BytesIO

import pytest
from pyspark.sql import functions as F

from impactlake.operators import keys, paging, rebuild
from impactlake.sources import http as web
from impactlake.sources import store

# --- entity keys ------------------------------------------------------------------------------------------------------


def walk(rows, spec):
    """Entities of one test's rows in order; a row is a dict with _p, its priority."""
    made, out = [], []
    for n, row in enumerate(rows):
        scope = [row[c] for c in spec.scope]
        inside = [e for e in made if [e["values"][c] for c in spec.scope] == scope]
        alike = [e for e in inside if all(e["values"][c] == row[c] for c in spec.fallback)]
        empty = all(row[c] is None for c in spec.fallback)
        if spec.number and row[spec.number] is not None:
            found = [e for e in inside if e["values"][spec.number] == row[spec.number]]
        elif spec.alone is not None and empty:
            found = [e for e in inside if e["values"][spec.number] is None] if scope[0] == spec.alone else []
        else:
            found = alike
        if found:
            e = found[0]
            for c in spec.columns:
                if row[c] is not None and (row["_p"] < e["first"] or e["values"][c] is None):
                    e["values"][c] = row[c]
        else:
            e = {"id": n, "first": row["_p"], "values": {c: row[c] for c in spec.columns}}
            made.append(e)
        out.append(e["id"])
    return out


@pytest.mark.parametrize("table", ["vehicles", "participants", "barriers", "channels"])
def test_entities_equal_a_walk_over_a_thousand_random_orders(spark, table):
    spec, r, rows, want = keys.SPECS[table], random.Random(7), [], {}
    pick = {"kind": ["barrier", "subject_vehicle"], spec.number: [None, None, "1", "2"]}
    for test in range(1000):
        own = [{c: r.choice(pick.get(c, [None, "A", "B"])) for c in spec.columns} | {"_p": r.randint(0, 3)} for _ in range(r.randint(1, 12))]
        for pos, (row, e) in enumerate(zip(own, walk(own, spec))):
            rows.append((test, pos, row["_p"], *[row[c] for c in spec.columns]))
            want[test, pos] = e
    df = spark.createDataFrame(rows, f"test_no long, pos int, p int, {', '.join(f'{c} string' for c in spec.columns)}").repartition(4)
    got = keys.resolve(df, spec, ["pos"], "p").select("test_no", "pos", "entity_key").collect()
    assert len(got) == len(rows)
    ours: dict = {}
    for x in got:
        ours.setdefault((x.test_no, x.entity_key), set()).add(x.pos)
    theirs: dict = {}
    for (test, pos), e in want.items():
        theirs.setdefault((test, e), set()).add(pos)
    assert {(t, frozenset(v)) for (t, _), v in ours.items()} == {(t, frozenset(v)) for (t, _), v in theirs.items()}


def test_rows_are_numbered_not_sorted_as_text(spark):
    df = spark.createDataFrame([("$.results[10]",), ("$.results[2]",), ("$.results[2].TEST[0]",)], "p string")
    assert [x.p for x in df.orderBy(keys.place(F.col("p"))).collect()] == ["$.results[2]", "$.results[2].TEST[0]", "$.results[10]"]


def test_true_keys_of_the_tables():
    assert {k: (v.scope, v.number, v.fallback, v.alone) for k, v in keys.SPECS.items() if v.number} == {
        "vehicles": ((), "vehicle_no", ("make", "model", "model_year"), None),
        "participants": (("kind",), "vehicle_no", ("name",), "barrier"),
    }
    assert keys.SPECS["barriers"].fallback == ("rigidity", "shape", "angle_raw") and keys.SPECS["channels"].fallback == ("curve_no",)


# --- pages ------------------------------------------------------------------------------------------------------------


def page(number, count, total, next_url=None):
    return json.dumps({"meta": {"pagination": {"pageNumber": number, "count": count, "total": total, "nextUrl": next_url}}, "results": [{"n": number}] * count})


def opener(pages, asked):
    """Answers by page number; an int is an error status."""

    def open_(url):
        asked.append(url)
        n = int(url.rpartition("pageNumber=")[2])
        body = pages.get(n, 404)
        if isinstance(body, int):
            raise urllib.error.HTTPError(url, body, "no", {}, None)
        answer = BytesIO(body.encode())
        answer.status = 200
        return answer

    return open_


ONE, THREE = {0: page(0, 2, 2)}, {0: page(0, 2, 5, "x"), 1: page(1, 2, 5, "x"), 2: page(2, 1, 5)}
WALKS = {
    "one": (ONE, [0], "complete"),
    "three": (THREE, [0, 1, 2], "complete"),
    "counts_go_on": ({0: page(0, 2, 4), 1: page(1, 2, 4)}, [0, 1], "complete"),  # no next URL, but rows are lacking
    "next_goes_on": ({0: page(0, 5, 5, "x"), 1: page(1, 0, 5)}, [0, 1], "complete"),  # all rows, but a next URL
    "missing": ({0: page(0, 2, 6, "x"), 1: page(1, 2, 6, "x")}, [0, 1], "missing"),
    "broken_later": ({0: page(0, 2, 6, "x"), 1: "<html>"}, [0, 1], "no_pagination"),
    "plain": ({0: "[1, 2]"}, [0], "no_pagination"),
    "failed": ({}, [0], "failed"),
    "repeats": ({n: page(0, 2, 9, "x") for n in range(99)}, [0], "repeats"),
}


@pytest.mark.parametrize("name", sorted(WALKS))
def test_page_walks(name):
    pages, taken, ended = WALKS[name]
    asked = []
    got = list(web.walk("search", "http://h/by-search?count=2&pageNumber=7", opener=opener(pages, asked), sleep=lambda s: None))
    assert [x[5] for x in got] == taken and [x[6] for x in got] == [None] * (len(taken) - 1) + [ended]
    assert asked[0] == "http://h/by-search?count=2&pageNumber=0" and len(asked) == len(set(asked)) <= len(taken) + 1
    if ended == "failed":
        assert got[0][2:4] == (404, None)


def test_http_source_follows_pages_through_spark(spark):
    """One partition a walk, against a server on this machine."""

    class Handler(http.server.BaseHTTPRequestHandler):
        def do_GET(self):
            name, _, n = self.path.strip("/").partition("?pageNumber=")
            body = {"one": ONE, "three": THREE}.get(name, {}).get(int(n or 0))
            self.send_response(200 if body else 404)
            self.end_headers()
            self.wfile.write((body or "").encode())

        def log_message(self, *_):
            pass

    server = http.server.ThreadingHTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    try:
        base = f"http://127.0.0.1:{server.server_port}"
        spark.dataSource.register(web.HttpSource)
        reader = spark.read.format("payload_http").option("live", "true").option("allowNetwork", "true").option("delaySeconds", "0")
        df = reader.option("pages", "follow").option("requests", json.dumps([[n, f"{base}/{n}"] for n in ("one", "three", "none")])).load()
        assert df.rdd.getNumPartitions() == 3
        assert sorted((x.endpoint, x.page, x.status, x.ended) for x in df.collect()) == [("none", 0, 404, "failed"), ("one", 0, 200, "complete"), ("three", 0, 200, None), ("three", 1, 200, None), ("three", 2, 200, "complete")]
        plain = reader.option("pages", "").option("requests", json.dumps([["three", f"{base}/three?pageNumber=1"]])).load().collect()
        assert [(x.endpoint, x.status, x.body) for x in plain] == [("three", 200, THREE[1])]
    finally:
        server.shutdown()
    with pytest.raises(Exception, match="live"):
        spark.read.format("payload_http").option("requests", "[]").load().collect()


def test_landed_pages_walk_as_live_ones_do(spark):
    rows, want = [], {}
    for name, (pages, taken, ended) in WALKS.items():
        if name != "repeats":  # a landed table has no page twice under two numbers
            rows += [(name, n, i, b) for n, b in pages.items() if not isinstance(b, int) for i in range(2)]
            want[name] = (len(taken) if ended != "failed" else 0, ended if ended != "failed" else "not_found")
    rows.append(("missing", 5, 0, page(5, 1, 6)))
    df = spark.createDataFrame(rows, "w string, page int, fetch int, body string")
    parts = paging.page_parts(F.try_parse_json("body"))
    wanted = spark.createDataFrame([(n,) for n in want], "w string")
    got = paging.walks(wanted, df.select("w", "page", "fetch", *[c.alias(k) for k, c in parts.items()]), ["w"], ["fetch"]).collect()
    assert {x.w: (x.page_count, x.ended) for x in got} == want


# --- stored tables ----------------------------------------------------------------------------------------------------


def files(folder):
    return {str(f): f.stat().st_mtime_ns for f in folder.rglob("part-*.parquet")}


def test_changes_touch_only_their_buckets(spark, tmp_path):
    base = spark.range(400).select(F.col("id").alias("k"), (F.col("id") % 3).alias("v"))
    table = store.Buckets(spark, f"file://{tmp_path}/t", ["k"], 8)
    with pytest.raises(FileNotFoundError):
        table.read()
    assert table.replace(base, base) == 1
    before = files(tmp_path)
    hit = {r[0] for r in base.where("k in (5, 6)").select(table.bucket()).collect()}
    assert table.upsert(spark.createDataFrame([(5, 70), (6, 71), (5, 72)], "k long, v long"), order=["v"]) == 2
    after = files(tmp_path)
    assert all(after[f] == m for f, m in before.items())  # nothing of the old version is touched
    assert {int(f.split("_bucket=")[1].split("/")[0]) for f in set(after) - set(before)} == hit
    want = {k: k % 3 for k in range(400)} | {5: 72, 6: 71}
    assert {x.k: x.v for x in table.read().collect()} == want and table.read().count() == 400
    assert {x.k: x.v for x in table.read(1).collect()}[5] == 2  # the old version is still there
    again = store.Buckets(spark, f"file://{tmp_path}/t", ["other"], 99)
    assert (again.key, again.buckets) == (["k"], 8) and again.read().count() == 400
    assert table.upsert(spark.createDataFrame([], "k long, v long")) == 2  # nothing to do, no new version
    table.replace(spark.createDataFrame([(7,)], "k long"), base.limit(0))
    assert table.read().count() == 399 and table.vacuum() > 0 and table.versions() == [3] and table.read().count() == 399


def test_a_lost_write_leaves_the_old_version(spark, tmp_path, monkeypatch):
    base = spark.range(50).select(F.col("id").alias("k"), F.lit("old").alias("v"))
    table = store.Buckets(spark, f"file://{tmp_path}/t", ["k"], 4)
    table.replace(base, base)
    new = base.withColumn("v", F.lit("new"))
    monkeypatch.setattr(store.Buckets, "_swap", lambda *_: 1 / 0)  # all files are written, the pointer is not
    with pytest.raises(ZeroDivisionError):
        table.upsert(new)
    monkeypatch.undo()
    assert {x.v for x in table.read().collect()} == {"old"} and table.versions() == [1]
    bad = new.withColumn("v", F.when(F.col("k") < 49, F.col("v")).otherwise(F.raise_error(F.lit("lost"))))
    with pytest.raises(Exception, match="lost"):
        table.upsert(bad)
    assert {x.v for x in table.read().collect()} == {"old"} and table.read().count() == 50
    table.vacuum()
    table.upsert(new)
    assert {x.v for x in table.read().collect()} == {"new"} and table.read().count() == 50


def test_two_writers_cannot_both_end(spark, tmp_path):
    base = spark.range(10).select(F.col("id").alias("k"))
    table = store.Buckets(spark, f"file://{tmp_path}/t", ["k"], 2)
    table.replace(base, base)
    manifest = table._manifest()
    table._swap(1, manifest)
    with pytest.raises(store.Conflict):
        table._swap(1, manifest)


def test_null_keys_and_new_columns(spark, tmp_path):
    table = store.Buckets(spark, f"file://{tmp_path}/t", ["k"], 4)
    first = spark.createDataFrame([(None, 1), (1, 1)], "k long, v long")
    table.replace(first, first)
    table.upsert(spark.createDataFrame([(None, 2, "x")], "k long, v long, w string"))
    assert sorted(((x.k, x.v, x.w) for x in table.read().collect()), key=repr) == [(1, 1, None), (None, 2, "x")]


# --- rebuilds ---------------------------------------------------------------------------------------------------------


def payload(number, endpoint, test, *results):
    return number, endpoint, test, json.dumps({"results": list(results)})


def test_rebuild_of_a_tenth_leaves_the_rest_and_repeats_alike(spark, tmp_path):
    rows = []
    for n in range(40):
        rows.append(payload(f"a{n}", "test_summary", n, {"testNo": n, "testDate": "2015-01-02", "testType": "X"}))
        rows.append(payload(f"b{n}", "vehicle_info", n, {"vehicleNo": 1, "vehicleMake": "A", "vehicleModel": None}, {"vehicleNo": 2, "vehicleMake": "NHTSA", "vehicleModel": "MOVING IMPACTOR"}, {"vehicleMake": "A"}))
        rows.append(payload(f"c{n}", "vehicle_detail", n, {"vehicleNo": 1, "vehicleModel": f"M{n}", "modelYear": 2014}))
    schema = "payload_id string, endpoint_name string, test_no int, body string"
    frame = lambda r: spark.createDataFrame(r, schema).withColumn("payload", F.parse_json("body"))
    from impactlake.operators import rebuild

    catalog = rebuild.Catalog(spark, f"file://{tmp_path}/c", 8, ("tests", "vehicles", "participants"))
    catalog.rebuild(frame(rows))
    cars = {(x.test_no, x.vehicle_no): x for x in catalog.read("vehicles").collect()}
    assert len(cars) == 80 and cars[3, 1].model == "M3" and cars[3, 1].make == "A" and cars[3, 1].source_rows == 3  # the row without a number is found by its values
    assert sorted(x.kind for x in catalog.read("participants").where("test_no = 3 and vehicle_no is not null").collect()) == ["impactor_vehicle", "subject_vehicle"]
    before, stored = files(tmp_path), sorted(map(repr, catalog.read("vehicles").collect()))
    few = spark.createDataFrame([(4,), (14,), (24,), (34,)], "test_no int")
    catalog.rebuild(frame(rows), few)
    assert sorted(map(repr, catalog.read("vehicles").collect())) == stored  # a repeated run gives equal rows
    touched = {r[0] for r in few.select(catalog.tables["vehicles"].bucket()).collect()}
    now = files(tmp_path)
    assert all(now[f] == m for f, m in before.items()) and {int(f.split("_bucket=")[1].split("/")[0]) for f in set(now) - set(before)} <= touched
    early = [r if r[0] not in ("a4", "a14") else payload(r[0], r[1], r[2], {"testNo": r[2], "testDate": {"a4": "2001-01-01", "a14": "soon"}[r[0]]}) for r in rows]
    catalog.rebuild(frame(early), few)  # two tests fall out of scope
    assert {x.test_no for x in catalog.read("tests").collect()} == {x.test_no for x in catalog.read("vehicles").collect()} == set(range(40)) - {4, 14}


# --- stored tables without large broadcasts ---------------------------------------------------------------------------


def test_many_keys_are_not_broadcast(spark, tmp_path, monkeypatch):
    """What a table is asked for may be far more than the driver holds: beyond a few keys the joins are told so; the asked tests are worked out once."""
    from impactlake.plans import stores

    monkeypatch.setattr(store, "FEW", 2)
    table, plans = store.Buckets(spark, f"file://{tmp_path}/t", ["k"], 2), []
    rows = spark.createDataFrame([(i, i * i) for i in range(6)], "k long, v long")
    table.replace(rows, rows)
    change = table.change
    monkeypatch.setattr(table, "change", lambda keys, rows, fold, *r, **k: change(keys, rows, lambda x: plans.append(fold(x)) or fold(x), *r, **k))
    table.replace(rows.where("k < 3"), rows.withColumn("v", F.lit(0)))
    assert sorted(map(tuple, table.read().collect())) == [(0, 0), (1, 0), (2, 0), (3, 9), (4, 16), (5, 25)]
    assert "Broadcast" not in plans[0]._jdf.queryExecution().sparkPlan().toString()
    assert "Broadcast" not in stores.payloads(spark, "/root/testdata/sf0.001", F.col("p_brand"))._jdf.queryExecution().sparkPlan().toString()
    exploded = spark.createDataFrame([(1, "test_summary", "$.results[0]")], "test_no int, section string, json_path string").withColumn("data", F.parse_json(F.lit('{"testDate": "2016-01-02"}')))
    exploded.write.parquet(str(tmp_path / "rows"))
    inside = rebuild.in_scope(spark.read.parquet(str(tmp_path / "rows")))
    assert inside.count() == 1 and "Broadcast" not in inside._jdf.queryExecution().sparkPlan().toString()


def test_descent_looks_at_nothing_below_what_it_found(spark, monkeypatch):
    """Objects that were found are not opened; texts that look like objects, and lists, are told as before."""
    from impactlake.operators import descent

    opened = []

    def spy(level, key, real=descent._children):
        opened.extend(x.node for x in level.select("node").collect())
        return real(level, key)

    monkeypatch.setattr(descent, "_children", spy)
    bodies = ['{"n": 1, "a": {"b": {"n": 1}}}', '{"z": "{\\"n\\": 1}", "y": [[], {"n": 1, "c": [{"d": 1}]}]}', "[null, 3]", '{"q": 1}']
    df = spark.createDataFrame(list(enumerate(bodies)), "k long, body string")
    got = descent.first_object(df, ["k"], "body", lambda v: F.try_variant_get(v, "$.n", "long") == 1).collect()
    assert {x.k: (x.node, x.path) for x in got} == {0: (bodies[0], []), 1: ('{"n":1,"c":[{"d":1}]}', [1, 1])}
    assert not any(x.startswith('{"n"') for x in opened) and len(opened) == 5
