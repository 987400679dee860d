"""Page walks, stored rebuilds and upserts, lookups in stages, and descent into payloads, on the star schema."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import Window

from .. import session
from ..functions import presence
from ..operators import descent, paging, rebuild, validation
from ..sources import store
from ..streaming import catalog
from .queries import lines, query, t

# the events of a user in pages of eight, as an API gives them; some pages were never landed, some twice
PAGES = """SELECT user_id, page, count(*) AS n, any_value(total) AS total, CASE WHEN (page + 1) * 8 < any_value(total) THEN 'next' END AS next_url FROM (
    SELECT user_id, (row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1) // 8 AS page, count(*) OVER (PARTITION BY user_id) AS total FROM events) GROUP BY 1, 2"""


def landed_pages(spark, d):
    e = t(spark, d, "events").select("user_id", "event_id")
    row = F.row_number().over(Window.partitionBy("user_id").orderBy("event_id")) - 1
    counts = e.groupBy("user_id").agg(F.count(F.lit(1)).alias("total"))
    pages = e.withColumn("page", F.floor(row / 8).cast("int")).groupBy("user_id", "page").agg(F.count(F.lit(1)).alias("count")).join(counts, "user_id")
    body = F.to_json(F.struct(F.struct(F.struct("count", "total", F.when((F.col("page") + 1) * 8 < F.col("total"), "next").alias("nextUrl")).alias("pagination")).alias("meta")))
    plain = F.when((F.col("user_id") % 17 == 5) & (F.col("page") == 2), "[1]").otherwise(body)
    sent = pages.select("user_id", "page", F.try_parse_json(plain).alias("payload")).where("(user_id + page) % 19 != 18")
    return sent.select("user_id", "page", F.explode(F.when(F.col("page") % 5 == 0, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))).alias("fetch"), *[c.alias(n) for n, c in paging.page_parts(F.col("payload")).items()])


@query(f"""WITH p AS (SELECT *, (user_id % 17 = 5 AND page = 2) AS plain FROM ({PAGES}) WHERE (user_id + page) % 19 <> 18),
    gap AS (SELECT user_id, min(page) AS g FROM (SELECT user_id, unnest(range(0, CAST(max(page) AS BIGINT) + 2)) AS page FROM p GROUP BY 1) q WHERE NOT EXISTS (SELECT 1 FROM p WHERE p.user_id = q.user_id AND p.page = q.page) GROUP BY 1),
    stop AS (SELECT p.user_id, min(page) FILTER (plain OR (next_url IS NULL)) AS e FROM p JOIN gap ON gap.user_id = p.user_id AND page < g GROUP BY 1),
    took AS (SELECT p.*, g, e FROM p JOIN gap USING (user_id) JOIN stop USING (user_id) WHERE page < g AND page <= coalesce(e, page))
    SELECT u.user_id, coalesce(count(took.page), 0) AS page_count, CAST(coalesce(sum(CASE WHEN plain THEN 0 ELSE n END), 0) AS BIGINT) AS row_count, CASE WHEN bool_or(plain) THEN 0 ELSE max(total) END AS total,
           CASE WHEN count(took.page) = 0 THEN 'not_found' WHEN bool_or(plain) THEN 'no_pagination' WHEN max(e) IS NOT NULL THEN 'complete' ELSE 'missing' END AS ended
    FROM (SELECT DISTINCT user_id FROM events) u LEFT JOIN took ON took.user_id = u.user_id GROUP BY 1""")
def page_walk(spark, d):
    return paging.walks(t(spark, d, "events"), landed_pages(spark, d), ["user_id"], ["fetch"])


@query("""SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice FROM orders WHERE o_orderkey % 7 <> 3
    UNION ALL SELECT o_orderkey, o_custkey, 'U', 2 * (o_orderkey % 5) FROM orders WHERE o_orderkey % 7 = 3 AND o_orderkey % 4 = 1
    UNION ALL SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice FROM orders WHERE o_orderkey % 7 = 3 AND o_orderkey % 4 <> 1
    UNION ALL SELECT -1 - o_orderkey, o_custkey, 'N', 2 FROM orders WHERE o_orderkey % 11 = 0""")
def stored_upsert(spark, d):
    """Changed orders and new ones put into a stored table; of each change two came, and the later one counts."""
    o = t(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice")
    table = store.Buckets(spark, session.workspace(spark), ["o_orderkey"], 16)
    table.replace(o, o)
    times = F.explode(F.array(F.lit(1.0), F.lit(2.0))).alias("turn")
    k = F.col("o_orderkey")
    changed = o.where((k % 7 == 3) & (k % 4 == 1)).select("o_orderkey", "o_custkey", F.lit("U").alias("o_orderstatus"), times).withColumn("o_totalprice", F.col("turn") * (k % 5))
    new = o.where(k % 11 == 0).select((-1 - k).alias("o_orderkey"), "o_custkey", F.lit("N").alias("o_orderstatus"), times).withColumn("o_totalprice", F.col("turn"))
    table.upsert(changed.unionByName(new), order=["turn"])
    return table.read()


VEHICLES = """SELECT test_no, vehicle_no, min(make) AS make, arg_min(size, make) AS model_year, min(size) AS least_year FROM (
    SELECT l_orderkey AS test_no, l_linenumber AS vehicle_no, p_brand AS make, min(p_size) AS size FROM lineitem JOIN part ON p_partkey = l_partkey GROUP BY 1, 2, 3) GROUP BY 1, 2"""


@query(f"""SELECT test_no, CAST(vehicle_no AS INTEGER) AS vehicle_no, CASE WHEN test_no % 10 = 1 THEN 'AGAIN' ELSE make END AS make, CAST(CASE WHEN test_no % 10 = 1 THEN least_year ELSE model_year END AS INTEGER) AS model_year FROM ({VEHICLES})
    WHERE test_no IN (SELECT o_orderkey FROM orders WHERE (o_orderkey % 10 <> 1 AND o_orderdate >= '1995-01-01') OR (o_orderkey % 10 = 1 AND o_orderdate >= '1997-01-01'))""")
def stored_rebuild(spark, d):
    """Vehicles derived from payloads, then those of a tenth of the tests again from new payloads, with a later scope: the others stay as they were stored."""
    return rebuilt_catalog(spark, d).read("vehicles").select("test_no", "vehicle_no", "make", "model_year")


def payloads(spark, d, make):
    """An order's summary and its lines as two payloads of a test."""
    o = t(spark, d, "orders").select(F.col("o_orderkey").alias("test_no"), "o_orderdate")
    dates_ = o.select("test_no", F.lit("test_summary").alias("endpoint_name"), F.to_json(F.struct(F.array(F.struct(F.col("o_orderdate").cast("date").cast("string").alias("testDate"))).alias("results"))).alias("body"))
    row = F.struct(F.col("l_linenumber").alias("vehicleNo"), make.alias("vehicleMake"), F.col("p_size").alias("modelYear"))
    # parts are read in each of several runs: as broadcasts their tables would pile up on the driver
    v = lines(spark, d, "merge").groupBy(F.col("l_orderkey").alias("test_no")).agg(F.to_json(F.struct(F.sort_array(F.collect_list(row)).alias("results"))).alias("body"))
    both = dates_.unionByName(v.select("test_no", F.lit("vehicle_info").alias("endpoint_name"), "body"))
    return both.select(F.sha2("body", 256).alias("payload_id"), "endpoint_name", "test_no", F.parse_json("body").alias("payload"))


def rebuilt_catalog(spark, d):
    stored = rebuild.Catalog(spark, session.workspace(spark), 16, ("vehicles",))
    stored.rebuild(payloads(spark, d, F.col("p_brand")), least="1995-01-01")
    again = t(spark, d, "orders").where("o_orderkey % 10 = 1").select(F.col("o_orderkey").alias("test_no"))
    stored.rebuild(payloads(spark, d, F.lit("AGAIN")), again, least="1997-01-01")
    return stored


# a decoy of another number first, a text that looks like the object, and the object 1 to 6 levels down; then one that comes too late
NODE = """'{"testNo": ' || event_id || ', "vehicleMake": "' || event_type || '", "modelYear": ' || user_id || '}'"""


@query("SELECT event_id, event_type AS make, CAST(user_id AS INTEGER) AS model_year, CAST(CASE event_id % 6 WHEN 0 THEN 0 WHEN 1 THEN 1 WHEN 2 THEN 2 WHEN 3 THEN 3 WHEN 4 THEN 5 ELSE 6 END AS INTEGER) AS depth FROM events WHERE event_id % 13 <> 12")
def identity_descent(spark, d):
    """The first object that names the event, at depths 0 to 6; keys are not in alphabetical order, and payloads without one give no row."""
    late = F.expr("""', "after": {"testNo": ' || event_id || ', "vehicleMake": "LATE"}'""")
    node, decoy = F.expr(NODE), F.lit('"z": "{\\"testNo\\": 1}", "y": [{"testNo": -1, "vehicleMake": "OTHER"}, "[1]", null, 3], ')
    put = lambda before, after: F.concat(F.lit("{"), decoy, F.lit(before), node, F.lit(after), late, F.lit("}"))
    forms = [node, put('"b": ', ""), put('"b": [', "]"), put('"results": [{"a": ', "}]"), put('"results": [[[{"a": ', "}]]]"), put('"m": {"results": [{"n": [{"a": ', "}]}]}")]
    body = forms[-1]
    for i, form in enumerate(forms[:-1]):
        body = F.when(F.col("event_id") % 6 == i, form).otherwise(body)
    e = t(spark, d, "events").select("event_id", F.when(F.col("event_id") % 13 == 12, F.lit('{"testNo": -5, "a": [[]]}')).otherwise(body).alias("body"))
    v = F.parse_json("node")
    found = descent.first_object(e, ["event_id"], "body", lambda v: presence.get(v, "testNo", "long") == F.col("event_id"))
    return found.select("event_id", presence.get(v, "vehicleMake").alias("make"), presence.get(v, "modelYear", "int").alias("model_year"), "depth")


SEEDS = "SELECT o_orderkey AS test_no, CAST(o_orderdate AS DATE) AS test_date, o_orderstatus AS test_configuration, CAST(NULL AS VARCHAR) AS test_type, o_custkey AS model_year, o_orderpriority AS vehicle_make, '' AS vehicle_model FROM orders"


@query(f"""SELECT test_no, status AS validation_status, CASE WHEN status LIKE 'validated%' THEN 'authoritative_included' WHEN status IN ('date_conflict', 'excluded_date_missing_or_parse_failed') THEN 'excluded_date_conflict' ELSE status END AS authority_status,
      CASE WHEN status = 'excluded_not_live_validated' THEN NULL ELSE used END AS validation_endpoint, CASE WHEN status = 'validated_live_with_metadata_drift' THEN 'model_year,vehicle_make' ELSE '' END AS drift_fields, attempted FROM (
    SELECT test_no, CASE WHEN k = 0 THEN 'excluded_not_live_validated' WHEN k = 1 THEN 'excluded_date_missing_or_parse_failed' WHEN k IN (2, 3) AND test_date < DATE '1996-01-01' THEN 'excluded_out_of_scope' WHEN k = 4 AND test_date - 5000 < DATE '1996-01-01' THEN 'excluded_out_of_scope'
        WHEN k = 4 THEN 'date_conflict' WHEN k IN (5, 6) AND test_date < DATE '1996-01-01' THEN 'excluded_out_of_scope' WHEN k = 5 THEN 'validated_live_with_metadata_drift' ELSE CASE WHEN test_date < DATE '1996-01-01' THEN 'excluded_out_of_scope' ELSE 'validated_live' END END AS status,
      CASE WHEN k IN (1, 2) THEN 'test_detail' WHEN k IN (3, 4) THEN 'metadata_export' ELSE 'test_summary' END AS used,
      CASE WHEN k = 0 THEN 'test_summary:404:0;metadata_export:-:-;test_detail:200:1' WHEN k IN (1, 2) THEN 'test_summary:200:1;metadata_export:-:-;test_detail:200:1' WHEN k IN (3, 4) THEN 'test_summary:500:0;metadata_export:200:1' ELSE 'test_summary:200:1' END AS attempted
    FROM (SELECT *, test_no % 8 AS k FROM ({SEEDS})))""")
def validation_cascade(spark, d):
    """Seeds against three endpoints: errors, no answers, identities without a date, conflicts and drift."""
    s = t(spark, d, "orders").select(F.col("o_orderkey").alias("test_no"), F.col("o_orderdate").cast("date").alias("test_date"), F.col("o_orderstatus").alias("test_configuration"), F.lit(None).cast("string").alias("test_type"), F.col("o_custkey").alias("model_year"), F.col("o_orderpriority").alias("vehicle_make"), F.lit("").alias("vehicle_model"))
    k, day = F.col("test_no") % 8, lambda n=0: F.date_format(F.date_sub("test_date", n), "M/d/yyyy")

    def body(number, date, make=None, year=None):
        row = F.struct(F.lit(0).alias("zero"), F.struct(number.alias("testNo"), date.alias("testDate"), (make if make is not None else F.upper("vehicle_make")).alias("vehicleMake"), (year if year is not None else F.col("model_year")).alias("YEAR"), F.lit("Sled").alias("vehicleModel")).alias("TEST"))
        return F.to_json(F.struct(F.array(row).alias("results")))

    own, none = F.col("test_no"), F.lit(None).cast("string")
    of = lambda endpoint, status, text, when: s.where(when).select(F.lit(endpoint).alias("endpoint"), "test_no", F.lit(status).alias("http_status"), text.alias("body"))
    answers = [
        of("test_summary", 404, none, k == 0),
        of("test_summary", 200, body(own, F.lit("soon")), k.isin(1, 2)),
        of("test_summary", 500, none, k.isin(3, 4)),
        of("test_summary", 200, body(own, day(), F.lit("other"), F.lit(-1)), k == 5),
        of("test_summary", 200, body(own, day()), k > 5),
        of("metadata_export", 200, body(own, day()), k == 3),
        of("metadata_export", 200, body(own, day(5000)), k == 4),
        of("metadata_export", 200, body(own, F.lit("never asked")), k > 4),
        of("test_detail", 200, body(-own - 1, day()), k == 0),
        of("test_detail", 200, body(own, none), k == 1),
        of("test_detail", 200, body(own, day()), k == 2),
    ]
    cache = answers[0]
    for a in answers[1:]:
        cache = cache.unionByName(a)
    out = validation.validate(s, validation.from_cache(cache), ["test_summary", "metadata_export", "test_detail"], "1996-01-01")
    dash = lambda c: F.coalesce(c.cast("string"), F.lit("-"))
    tried = F.array_join(F.transform("attempted", lambda a: F.concat_ws(":", a["endpoint"], dash(a["http_status"]), dash(a["row_count"]))), ";")
    return out.select("test_no", "validation_status", "authority_status", "validation_endpoint", F.array_join("drift_fields", ",").alias("drift_fields"), tried.alias("attempted"))


@query("""WITH e AS (SELECT event_type, event_id, CAST(json_extract(props, '$.k') AS VARCHAR) AS example FROM events), f AS (SELECT event_type, example, min(event_id) AS came FROM e WHERE example IS NOT NULL GROUP BY 1, 2),
    r AS (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY came, example) AS n FROM f)
    SELECT c.event_type, c.seen_count, c.non_null_count, c.first_seen, c.last_seen, (SELECT string_agg(example, '|' ORDER BY n) FROM r WHERE r.event_type = c.event_type AND n <= 5) AS examples
    FROM (SELECT event_type, count(*) AS seen_count, count(example) AS non_null_count, min(event_id) AS first_seen, max(event_id) AS last_seen FROM e GROUP BY 1) c""")
def incremental_catalog(spark, d):
    """A stored catalog after three batches, of which the last holds the earliest events; a batch that comes again changes nothing."""
    e = t(spark, d, "events").select("event_type", F.col("event_id").alias("at"), F.get_json_object("props", "$.k").alias("example")).withColumn("non_null", F.col("example").isNotNull())
    table = store.Buckets(spark, session.workspace(spark), ["event_type"], 4)
    for batch, part in enumerate((2, 1, 0)):
        catalog.add(table, e.where(F.col("at") % 3 == part), "at", batch)
        catalog.add(table, e.where(F.col("at") % 3 == part), "at", batch)
    return catalog.examples(table.read()).withColumn("examples", F.array_join("examples", "|"))
