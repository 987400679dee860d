"""More operators on the star schema: reports, cardinalities, nested outputs, validation."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import session
from ..functions import dates, ratings, text, vehicles
from ..operators import audit, canonical, details, linkage, planning, readmodel, reports, scoring
from .queries import RANKED, L, cents, lines, query, ranked, t


@query("""SELECT pattern, count(*) AS key_count FROM (SELECT l_orderkey, string_agg(l_returnflag || ':' || n, ', ' ORDER BY l_returnflag || ':' || n) AS pattern
    FROM (SELECT l_orderkey, l_returnflag, count(*) AS n FROM lineitem GROUP BY 1, 2) GROUP BY 1) GROUP BY 1""")
def participant_patterns(spark, d):
    return reports.patterns(t(spark, d, "lineitem"), "l_orderkey", "l_returnflag")


@query("SELECT l_orderkey, l_returnflag, l_linestatus, count(*) AS asset_count FROM lineitem GROUP BY 1, 2, 3")
def asset_kinds(spark, d):
    return details.kind_counts(t(spark, d, "lineitem"), "l_orderkey", "l_returnflag", "l_linestatus")


@query("SELECT l_orderkey, count(*) AS row_count, count(*) FILTER (l_suppkey % 4 <> 0) AS assigned_count, count(*) FILTER (l_suppkey % 4 = 0 AND l_linenumber > 3) AS context_lost FROM lineitem GROUP BY 1")
def assignment_cardinality(spark, d):
    return reports.assignment_cardinality(t(spark, d, "lineitem"), "l_orderkey", F.col("l_suppkey") % 4 != 0, (F.col("l_suppkey") % 4 == 0) & (F.col("l_linenumber") > 3))


@query("""SELECT l_orderkey, row_count, key_count, source_count, CASE WHEN row_count = key_count THEN 'unique' WHEN source_count > 1 THEN 'merged_sources' ELSE 'repeated' END AS status
    FROM (SELECT l_orderkey, count(*) AS row_count, count(DISTINCT (l_returnflag, l_linestatus)) AS key_count, count(DISTINCT l_suppkey) AS source_count FROM lineitem GROUP BY 1)""")
def semantic_cardinality(spark, d):
    return reports.semantic_cardinality(t(spark, d, "lineitem"), "l_orderkey", ["l_returnflag", "l_linestatus"], "l_suppkey")


@query("""SELECT CASE WHEN o_orderkey % 13 = 0 THEN 'missing_test_date' WHEN o_orderkey % 7 = 0 THEN 'date_parse_failed' WHEN o_orderdate >= '1997-01-01' THEN 'in_scope' ELSE 'out_of_scope' END AS scope, count(*) AS n FROM orders GROUP BY 1""")
def scope_summary(spark, d):
    k = F.col("o_orderkey")
    o = t(spark, d, "orders").select(k, F.when(k % 13 != 0, F.col("o_orderdate").cast("date")).alias("date"))
    return reports.scope_summary(o, "date", F.when(k % 7 == 0, "invalid").otherwise("parsed"), "1997-01-01")


@query("SELECT count(*) AS row_count, count(DISTINCT o_custkey) AS distinct_count, min(CAST(o_orderdate AS DATE)) AS first_date, max(CAST(o_orderdate AS DATE)) AS last_date, count(*) - count(DISTINCT o_custkey) AS duplicate_count FROM orders")
def manifest_summary(spark, d):
    return reports.manifest_summary(t(spark, d, "orders").withColumn("d", F.col("o_orderdate").cast("date")), "o_custkey", "d")


@query("""SELECT 'p_brand' AS field, count(*) AS ours_filled, 2 * count(*) AS theirs_filled, 'partly_stored' AS status FROM part WHERE p_size < 10 AND false HAVING false
    UNION ALL SELECT field, ours, theirs, CASE WHEN theirs = 0 THEN 'not_in_source' WHEN ours = 0 THEN 'not_stored' WHEN ours < theirs THEN 'partly_stored' ELSE 'stored' END FROM (
      SELECT 'p_brand' AS field, (SELECT count(*) FROM part WHERE p_size < 10) AS ours, (SELECT count(*) FROM part) AS theirs
      UNION ALL SELECT 'p_name', 0, (SELECT count(*) FROM part) UNION ALL SELECT 'p_type', (SELECT count(*) FROM part), (SELECT count(*) FROM part WHERE p_partkey % 2 = 0))""")
def field_coverage(spark, d):
    p = t(spark, d, "part")
    ours = p.select(F.when(F.col("p_size") < 10, F.col("p_brand")).alias("p_brand"), F.lit("").alias("p_name"), "p_type")
    return reports.field_coverage(ours, p.select("p_brand", "p_name", F.when(F.col("p_partkey") % 2 == 0, F.col("p_type")).otherwise(" ").alias("p_type")), ["p_brand", "p_name", "p_type"])


@query("SELECT CASE WHEN l_linenumber > 5 THEN '<NULL>' ELSE l_returnflag END AS proxy, count(*) AS n FROM lineitem GROUP BY 1")
def proxy_distribution(spark, d):
    return reports.distribution(t(spark, d, "lineitem"), F.when(F.col("l_linenumber") <= 5, F.col("l_returnflag")), "proxy")


READY = "CASE WHEN p_size < 11 THEN 'year_missing_or_old' WHEN p_partkey % 9 = 0 THEN 'make_missing' WHEN p_partkey % 8 = 0 THEN 'model_missing' ELSE 'ready' END"


def readiness(spark, d):
    k = F.col("p_partkey")
    make, model = F.when(k % 9 != 0, F.col("p_brand")).otherwise(" "), F.when(k % 8 != 0, F.col("p_name"))
    return t(spark, d, "part").withColumn("ready", linkage.key_ready(F.col("p_size"), make, model, 11))


@query(f"SELECT {READY} AS ready, count(*) AS n FROM part GROUP BY 1")
def key_ready(spark, d):
    return readiness(spark, d).groupBy("ready").agg(F.count(F.lit(1)).alias("n"))


@query(f"""SELECT count(*) AS subject_count, count(*) FILTER (r = 'ready') AS ready_count, count(*) FILTER (r = 'ready' AND p_type = 'PROMO') AS matched_count,
    round_even(count(*) FILTER (r = 'ready' AND p_type = 'PROMO')::DOUBLE / count(*) FILTER (r = 'ready'), 6) AS match_rate FROM (SELECT p_type, {READY} AS r FROM part)""")
def match_rate(spark, d):
    return reports.match_rate(readiness(spark, d), F.col("ready") == "ready", F.col("p_type") == "PROMO")


@query(RANKED + " SELECT subject, count(*)::INTEGER AS candidate_count, string_agg(candidate || '/' || score, ' ' ORDER BY candidate_rank) AS shown FROM k WHERE candidate_rank <= 3 GROUP BY 1")
def subject_groups(spark, d):
    g = reports.subject_groups(ranked(spark, d), "subject", "candidate_rank", ["candidate", "score"], 3)
    return g.select("subject", F.size("candidates").alias("candidate_count"), F.array_join(F.transform("candidates", lambda x: F.concat(x["candidate"].cast("string"), F.lit("/"), x["score"].cast("string"))), " ").alias("shown"))


@query("SELECT o_orderkey, CAST(row_number() OVER (ORDER BY o_orderkey) AS INTEGER) AS selection_priority FROM (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F' ORDER BY o_orderkey LIMIT 40)")
def selection_priority(spark, d):
    few = t(spark, d, "orders").where("o_orderstatus = 'F'").select("o_orderkey").orderBy("o_orderkey").limit(40)
    return reports.with_priority(few, ["o_orderkey"])


@query("SELECT * FROM (VALUES ('p_brand', true), ('p_type', true), ('p_colour', false)) v(facet_name, present)")
def required_facets(spark, d):
    return reports.required_facets(readmodel.facets(t(spark, d, "part"), ["p_brand", "p_type"]), ["p_brand", "p_type", "p_colour"], spark)


@query("""SELECT o_orderstatus, o_orderkey, total_count FROM (SELECT o_orderstatus, o_orderkey, count(*) OVER (PARTITION BY o_orderstatus) AS total_count, row_number() OVER (PARTITION BY o_orderstatus ORDER BY o_orderkey) AS n
    FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)) WHERE n <= 20 ORDER BY o_orderstatus, o_orderkey LIMIT 50""")
def missing_matrix(spark, d):
    gone = audit.missing(t(spark, d, "orders").select("o_orderkey", "o_orderstatus"), t(spark, d, "lineitem").select(F.col("l_orderkey").alias("o_orderkey")), ["o_orderkey"])
    return reports.capped(gone, "o_orderstatus", ["o_orderkey"], 20, 50)


@query("""SELECT a.o_orderkey, array_to_string(list_filter([CASE WHEN a.o_orderkey % 3 = 0 AND a.o_orderstatus <> 'F' THEN 'status' END, CASE WHEN a.o_orderkey % 5 = 0 AND a.o_orderpriority <> '1-URGENT' THEN 'priority' END], lambda x: x IS NOT NULL), ',') AS drift FROM orders a""")
def drift_fields(spark, d):
    k = F.col("o_orderkey")
    live = {"status": F.when(k % 3 == 0, "f ").otherwise(F.col("o_orderstatus")), "priority": F.when(k % 5 == 0, "1-urgent").otherwise("")}
    return t(spark, d, "orders").select("o_orderkey", F.array_join(reports.drift({"status": F.col("o_orderstatus"), "priority": F.col("o_orderpriority")}, live), ",").alias("drift"))


@query("""SELECT p_partkey, '{' || CASE WHEN p_size % 7 BETWEEN 1 AND 5 THEN '"front":"' || (p_size % 7) || '"' || CASE WHEN p_size % 2 = 0 THEN ',"tip":"Tip"' ELSE '' END
      ELSE CASE WHEN p_size % 7 = 0 THEN '"front":"Not Rated"' || CASE WHEN p_size % 2 = 0 THEN ',"tip":"Tip"' ELSE '' END ELSE CASE WHEN p_size % 2 = 0 THEN '"tip":"Tip"' ELSE '' END END END || '}' AS payload FROM part""")
def fields_payload(spark, d):
    s = F.col("p_size")
    return t(spark, d, "part").select("p_partkey", reports.fields_payload({"tip": ("tip", F.when(s % 2 == 0, "Tip").otherwise("0")), "front": ("star", (s % 7).cast("string"))}).alias("payload"))


@query("""SELECT p_partkey, CASE WHEN p_size % 3 = 0 AND p_partkey % 2 = 0 THEN 'release_match' WHEN p_size % 3 = 0 AND p_partkey % 2 = 1 THEN 'release_conflict' WHEN p_size % 3 = 1 THEN 'release_unstated' ELSE 'no_release' END AS reason FROM part""")
def release_reason(spark, d):
    s, k = F.col("p_size"), F.col("p_partkey")
    release = F.when(s % 3 == 0, F.when(k % 2 == 0, "early").otherwise("Later"))
    text_ = F.when(s % 3 == 2, F.col("p_name")).otherwise(F.concat("p_name", F.lit(" early release")))
    return t(spark, d, "part").select("p_partkey", reports.release_reason(release, text_).alias("reason"))


@query("""SELECT event_type, n, CASE WHEN event_type = 'view' THEN 'done' WHEN n < 100 THEN 'watch' WHEN event_type = 'error' THEN 'manual_review' ELSE 'promote' END AS decision FROM (SELECT event_type, count(*) AS n FROM events GROUP BY 1)""")
def backlog_triage(spark, d):
    by = t(spark, d, "events").groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))
    status = F.when(F.col("event_type") == "view", "mapped").when(F.col("event_type") == "error", "conflict").otherwise("open")
    return by.withColumn("decision", reports.triage(status, F.col("n"), 100))


@query("SELECT o_orderkey, o_orderdate::DATE + CASE WHEN o_orderkey % 2 = 0 THEN 0 ELSE 1 END AS date FROM orders WHERE o_orderkey % 4 <> 3 UNION ALL SELECT o_orderkey, NULL FROM orders WHERE o_orderkey % 4 = 3")
def many_formats(spark, d):
    k = F.col("o_orderkey")
    day = F.date_add(F.col("o_orderdate").cast("date"), (k % 2).cast("int"))
    s = F.when(k % 4 == 0, F.date_format(day, "yyyy-MM-dd HH:mm:ss")).when(k % 4 == 1, F.date_format(day, "M/d/yyyy")).when(k % 4 == 2, F.date_format(day, "yyyyMMdd")).otherwise("someday")
    return t(spark, d, "orders").select("o_orderkey", dates.any_date(s).alias("date"))


@query("""SELECT kind, count(*) AS n FROM (SELECT CASE WHEN l_suppkey % 3 <> 0 AND l_linenumber <= 4 THEN 'occupant' WHEN l_suppkey % 3 <> 0 THEN 'vehicle' ELSE 'test' END AS kind FROM lineitem) GROUP BY 1""")
def restraint_identity(spark, d):
    from ..operators.merge import restraint_identity as identity

    kind = identity(F.when(F.col("l_suppkey") % 3 != 0, F.col("l_suppkey")), F.when(F.col("l_linenumber") <= 4, F.lit("LEFT_FRONT")))
    return t(spark, d, "lineitem").select(kind.alias("kind")).groupBy("kind").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT l_orderkey, sha256('order=' || l_orderkey || '|kind=' || upper(l_returnflag) || '|status=' || CASE WHEN l_linenumber % 2 = 0 THEN '<NULL>' ELSE upper(l_linestatus) END) AS assignment_key, count(*) AS n FROM lineitem GROUP BY 1, 2")
def assignment_key(spark, d):
    key = text.semantic_hash(order=F.col("l_orderkey"), kind=F.col("l_returnflag"), status=F.when(F.col("l_linenumber") % 2 == 1, F.col("l_linestatus")))
    return t(spark, d, "lineitem").select("l_orderkey", key.alias("assignment_key")).groupBy("l_orderkey", "assignment_key").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT l_orderkey, l_linenumber, l_suppkey, l_partkey FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_orderkey ORDER BY l_shipdate, l_linenumber, l_partkey, l_suppkey) = 1")
def first_spec(spark, d):
    return planning.best_row(t(spark, d, "lineitem"), ["l_orderkey"], ["l_shipdate", "l_linenumber", "l_partkey", "l_suppkey"]).select("l_orderkey", "l_linenumber", "l_suppkey", "l_partkey")


@query("SELECT o_orderkey FROM orders WHERE o_orderdate >= '2000-01-01' AND o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_linestatus = 'F')")
def resume(spark, d):
    have = t(spark, d, "lineitem").where("l_linestatus = 'F'").select(F.col("l_orderkey").alias("o_orderkey"))
    return details.resume(t(spark, d, "orders").where("o_orderdate >= '2000-01-01'"), have, None, "o_orderkey")


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN c_name ELSE 'own' END AS performer FROM orders LEFT JOIN customer ON c_custkey = o_custkey")
def fill_absent(spark, d):
    rows = t(spark, d, "orders").select("o_orderkey", F.col("o_custkey").alias("k"), F.when(F.col("o_orderkey") % 3 != 0, "own").otherwise("").alias("performer"))
    seeds = t(spark, d, "customer").select(F.col("c_custkey").alias("k"), F.col("c_name").alias("performer"))
    return planning.fill_absent(rows, seeds, "k", ["performer"]).select("o_orderkey", "performer")


@query("""SELECT p_partkey, CASE WHEN p_size % 4 = 0 THEN 100 WHEN p_size % 4 = 1 THEN 76 WHEN p_size % 4 = 2 THEN 86 ELSE 0 END AS score FROM part""")
def model_scores(spark, d):
    s = F.col("p_size") % 4
    api = F.when(s == 0, F.replace(F.upper("p_name"), F.lit(" "), F.lit("-"))).when(s == 1, F.concat("p_name", F.lit(" xl"))).when(s == 2, F.concat("p_name", F.lit(""))).otherwise("zzz")
    db = F.when(s == 2, F.concat("p_name", F.lit("LONG"))).otherwise(F.col("p_name"))
    return t(spark, d, "part").select("p_partkey", vehicles.model_name_score(db, api, F.lit("FORD")).alias("score"))


@query("""WITH b AS (SELECT l_partkey, l_suppkey AS id FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_partkey ORDER BY round(l_extendedprice * 100)::BIGINT DESC, l_suppkey, l_orderkey) = 1)
    SELECT l_partkey, min(l_suppkey) AS id FROM lineitem JOIN b USING (l_partkey) WHERE l_suppkey = id GROUP BY 1 HAVING count(*) = 1""")
def report_evidence(spark, d):
    c = t(spark, d, "lineitem").select("l_partkey", F.col("l_suppkey").alias("id"), cents("l_extendedprice").alias("price"), "l_orderkey")
    return linkage.unique_evidence(linkage.best_variant(c, "l_partkey", "price", ["id", "l_orderkey"]).select("l_partkey", "id"), c.select("l_partkey", "id"), "l_partkey", "id")


@query(f"""SELECT o_orderkey, o_orderstatus, c_name, (SELECT count(*) FROM lineitem WHERE l_orderkey = o_orderkey) AS line_count, (SELECT string_agg(DISTINCT p_brand, ',' ORDER BY p_brand) FROM {L} WHERE l_orderkey = o_orderkey) AS makes
    FROM orders JOIN customer ON c_custkey = o_custkey WHERE o_orderkey = 7""")
def test_detail(spark, d):
    o = t(spark, d, "orders").where("o_orderkey = 7").join(t(spark, d, "customer").select("c_custkey", "c_name"), F.col("c_custkey") == F.col("o_custkey"))
    kids = lines(spark, d).where("l_orderkey = 7").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count(F.lit(1)).alias("line_count"), F.array_join(F.array_sort(F.collect_set("p_brand")), ",").alias("makes"))
    return o.join(kids, "o_orderkey", "left").select("o_orderkey", "o_orderstatus", "c_name", F.coalesce("line_count", F.lit(0)).alias("line_count"), "makes")


@query("""SELECT p_partkey, p_brand, p_size, score FROM (SELECT p_partkey, p_brand, p_size, CAST(round(p_retailprice * 100) AS BIGINT) AS score FROM part) ORDER BY p_size, score DESC, p_partkey LIMIT 500""")
def recommendations(spark, d):
    p = t(spark, d, "part").select("p_partkey", "p_brand", "p_size", cents("p_retailprice").alias("score"))
    return audit.ordered(p, "p_size", F.desc("score"), "p_partkey", limit=500)


@query("""SELECT o_orderkey, CAST(CASE WHEN o_orderdate >= '2000-01-01' THEN 0 ELSE 1 END AS INTEGER) AS recent, o_orderpriority FROM orders ORDER BY recent, CASE WHEN o_orderpriority LIKE '%NOT SPECIFIED%' THEN 0 ELSE 1 END, o_orderkey LIMIT 60""")
def edge_cases(spark, d):
    o = t(spark, d, "orders").select("o_orderkey", F.when(F.col("o_orderdate") >= "2000-01-01", 0).otherwise(1).alias("recent"), "o_orderpriority")
    return audit.ordered(o, "recent", F.when(F.col("o_orderpriority").contains("NOT SPECIFIED"), 0).otherwise(1), "o_orderkey", limit=60)


@query("SELECT DISTINCT l_orderkey FROM lineitem WHERE l_returnflag = 'R' AND l_linestatus = 'F'")
def package_tests(spark, d):
    return t(spark, d, "lineitem").where("l_returnflag = 'R' and l_linestatus = 'F'").select("l_orderkey").distinct()


@query("SELECT code_set, count(*) AS value_count, sum(n)::BIGINT AS row_count FROM (SELECT 'brand' AS code_set, p_brand AS v, count(*) AS n FROM part GROUP BY 2 UNION ALL SELECT 'type', p_type, count(*) FROM part GROUP BY 2) GROUP BY 1")
def code_coverage(spark, d):
    p = t(spark, d, "part")
    return details.code_set_coverage(readmodel.code_values([("brand", p, "p_brand", "p_partkey"), ("type", p, "p_type", "p_partkey")]))


@query("SELECT l_linenumber AS test_no FROM lineitem GROUP BY 1")
def payload_numbers(spark, d):
    return t(spark, d, "lineitem").select(F.col("l_linenumber").alias("test_no")).distinct().orderBy("test_no")


@query("""SELECT p_partkey, a, b, c FROM (SELECT p_partkey, p_size % 5 = 0 AS moved, p_type AS x, p_brand AS y, CAST(p_size AS VARCHAR) AS z FROM part) s, LATERAL (SELECT CASE WHEN moved THEN y ELSE x END AS a, CASE WHEN moved THEN z ELSE y END AS b, CASE WHEN moved THEN NULL ELSE z END AS c)""")
def shifted_rows(spark, d):
    p = t(spark, d, "part").select("p_partkey", F.col("p_type").alias("a"), F.col("p_brand").alias("b"), F.col("p_size").cast("string").alias("c"), (F.col("p_size") % 5 == 0).alias("moved"))
    return p.select("p_partkey", *ratings.unshift(["a", "b", "c"], F.lit(False), F.col("moved")))


@query("""SELECT p_partkey, CASE WHEN p_type = 'PROMO' THEN 'research' WHEN p_type IN ('SMALL', 'LARGE') THEN 'compliance' ELSE 'rating' END AS cohort,
    array_to_string(list_filter([CASE WHEN p_size > 25 THEN 'large' END, CASE WHEN p_brand = 'Brand#1' THEN 'first' END], lambda x: x IS NOT NULL), ',') AS flags FROM part""")
def cohorts(spark, d):
    cohort = details.by_table(F.col("p_type"), {"PROMO": "research", "SMALL": "compliance", "LARGE": "compliance"}, "rating")
    flags = text.compact(text.flag("large", F.col("p_size") > 25), text.flag("first", F.col("p_brand") == "Brand#1"))
    return t(spark, d, "part").select("p_partkey", cohort.alias("cohort"), F.array_join(flags, ",").alias("flags"))


@query("""SELECT CASE WHEN contains(upper(p_name), 'RING') THEN 'ring' WHEN contains(upper(p_name), 'GEAR') THEN 'gear' ELSE 'other' END AS bucket, count(*) AS n FROM part GROUP BY 1""")
def configuration_bucket(spark, d):
    rules = [("ring", ["RING"]), ("gear", ["GEAR"])]
    return t(spark, d, "part").select(canonical.cascade(F.upper("p_name"), rules, "other").alias("bucket")).groupBy("bucket").agg(F.count(F.lit(1)).alias("n"))


@query("""WITH s AS (SELECT o_orderkey, o_orderstatus, c_name FROM orders JOIN customer ON c_custkey = o_custkey WHERE o_orderdate >= '1998-07-01' AND o_orderpriority = '1-URGENT'),
    x AS (SELECT o_orderkey, o_orderstatus, c_name, l_linenumber AS n, l_partkey, l_suppkey, l_returnflag AS f, p_brand FROM s LEFT JOIN lineitem ON l_orderkey = o_orderkey LEFT JOIN part ON l_partkey = p_partkey)
    SELECT o_orderkey, o_orderstatus, c_name, coalesce(string_agg(n || ':' || p_brand, ',' ORDER BY n, p_brand, l_partkey, l_suppkey), '') AS vehicles, coalesce(string_agg(DISTINCT f, ',' ORDER BY f), '') AS kinds,
      count(n) AS asset_count, count(n) FILTER (f = 'R') AS return_count, coalesce(max(n), 0) AS last_line FROM x GROUP BY 1, 2, 3""")
def nested_detail(spark, d):
    """Tests with five nested child sets, read back as texts and counts."""
    folder = session.workspace(spark)
    o = t(spark, d, "orders").where("o_orderdate >= '1998-07-01' and o_orderpriority = '1-URGENT'").join(t(spark, d, "customer"), F.col("c_custkey") == F.col("o_custkey")).select("o_orderkey", "o_orderstatus", "c_name")
    o, mine = session.kept(o, f"{folder}/orders"), t(spark, d, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), "l_linenumber", "l_partkey", "l_suppkey", "l_returnflag")
    mine = mine.join(o.select("o_orderkey").hint("shuffle_hash"), "o_orderkey", "left_semi")  # lines of other orders are dropped before parts are looked up
    li = session.kept(mine.join(t(spark, d, "part").select(F.col("p_partkey").alias("l_partkey"), "p_brand"), "l_partkey"), f"{folder}/lines")
    out = details.detail(o, {
        "vehicles": (li, ["l_linenumber", "p_brand", "l_partkey", "l_suppkey"]), "participants": (li.select("o_orderkey", "l_returnflag").distinct(), ["l_returnflag"]), "assets": (li, ["l_partkey"]),
        "restraints": (li.where("l_returnflag = 'R'"), ["l_suppkey"]), "channels": (li, ["l_linenumber"]),
    }, "o_orderkey")
    joined = lambda c, f: F.array_join(F.transform(c, f), ",")
    return out.select("o_orderkey", "o_orderstatus", "c_name", joined("vehicles", lambda x: F.concat(x["l_linenumber"].cast("string"), F.lit(":"), x["p_brand"])).alias("vehicles"), joined("participants", lambda x: x["l_returnflag"]).alias("kinds"),
                      F.size("assets").cast("long").alias("asset_count"), F.size("restraints").cast("long").alias("return_count"), F.coalesce(F.array_max(F.transform("channels", lambda x: x["l_linenumber"])), F.lit(0)).alias("last_line"))


NAME = "regexp_replace({}, '[^A-Z0-9]', '', 'g')"


@query(f"""WITH own AS (SELECT p_partkey, p_brand AS make, p_size % 3 AS year, upper(CASE WHEN p_partkey % 3 = 0 THEN p_name || ' wagon' WHEN p_partkey % 3 = 1 THEN p_name ELSE split_part(p_name, ' ', 1) END) AS model FROM part),
    api AS (SELECT DISTINCT p_brand AS make, p_size % 3 AS year, replace(upper(p_name), ' ', '-') || CASE WHEN p_size > 25 THEN '-S' ELSE '' END AS api_model FROM part),
    k AS (SELECT DISTINCT make, year, model FROM own), p AS (SELECT k.*, api_model, {NAME.format("model")} AS a, {NAME.format("api_model")} AS b, list_distinct(list_filter(string_split_regex(model, '[^A-Z0-9]+'), lambda w: len(w) > 1)) AS x,
      list_distinct(list_filter(string_split_regex(api_model, '[^A-Z0-9]+'), lambda w: len(w) > 1)) AS y FROM k JOIN api USING (make, year)),
    s AS (SELECT *, CASE WHEN a = b THEN 100 WHEN starts_with(a, b) AND len(b) >= 4 THEN 86 WHEN starts_with(b, a) AND len(a) >= 2 THEN 76 WHEN len(list_intersect(x, y)) > 0 AND len(list_intersect(x, y)) = len(x) THEN 70
      WHEN len(list_intersect(x, y)) > 0 AND len(list_intersect(x, y)) = len(y) THEN 76 ELSE 0 END AS score FROM p),
    t AS (SELECT *, max(score) OVER (PARTITION BY make, year, model) AS best FROM s WHERE score >= 76), r AS (SELECT *, row_number() OVER (PARTITION BY make, year, model ORDER BY len(api_model), api_model) AS match_rank FROM t WHERE score = best)
    SELECT p_partkey, upper(make) AS match_make, api_model, score, CAST(match_rank AS INTEGER) AS match_rank FROM own JOIN r USING (make, year, model) WHERE match_rank <= 8""")
def model_matches(spark, d):
    """Models of one list in another of the same make and year, whatever the score, with the cap."""
    k = F.col("p_partkey") % 3
    name = F.when(k == 0, F.concat("p_name", F.lit(" wagon"))).when(k == 1, F.col("p_name")).otherwise(F.split("p_name", " ")[0])
    p = t(spark, d, "part").select("p_partkey", F.col("p_brand").alias("make"), (F.col("p_size") % 3).alias("year"), name.alias("model"))
    long = F.concat(F.replace(F.upper("p_name"), F.lit(" "), F.lit("-")), F.when(F.col("p_size") > 25, "-S").otherwise(""))
    api = t(spark, d, "part").select(F.col("p_brand").alias("make"), (F.col("p_size") % 3).alias("year"), long.alias("api_model"))
    return details.model_matches(p, api, "p_partkey", year="year")


def _score_case(rules, kind):
    """The rules one by one as SQL: a list of (weight, reason), distinct by token and weight."""
    def holds(a):
        f, op, w = next((a[: a.find(c)], c, a[a.find(c) + 1 :]) for c in ":=#-" if c in a and a[: a.find(c)].replace("_", "").isalpha())
        return {":": f"contains({f}, '{w}')", "=": f"{f} = '{w}'", "#": f"contains({NAME.format(f)}, '{w}')", "-": f"contains(replace({f}, ' ', ''), '{w}')"}[op]

    return "[" + ", ".join(f"CASE WHEN ({' OR '.join(map(holds, when))}) AND contains(said, '{t}') THEN {{'i': {i * 10 + j}, 'n': {w}, 'why': '{kind}:{t.strip()}+{w}', 't': '{t}'}} END" for i, (when, tokens) in enumerate(rules) for j, (t, w) in enumerate(tokens)) + "]"


CARS = ["Four Door Sedan", "two door coupe", "Five Door Hatchback", "THREE DOOR", "station  wagon", "Minivan", "Sport Utility", "Extended Cab Pickup", "4 Door Pickup", "truck", "Convertible", ""]
TRUCKS = ["F-150 SuperCrew", "Ranger Super Cab", "Tundra Double Cab", "Colorado Regular Cab", "Prius", "A4"]
DRIVES = ["AWD", "4x2", "4 X 2", "Front wheel", "RWD/Rear", "4-Wheel", ""]
CABS = ["Crew", "King cab", "Regular", "", "Extended"]
TEXTS = ["F-150 SUPER CREW PU/CC 4WD", "RANGER SUPERCAB PU/EC RWD", "4 DR SEDAN FWD", "2 DR COUPE 4-DR AWD", "5 HB HATCH HYBRID", "SW WAGON 4X2", "MINIVAN VAN", "SUV UTILITY AWD EV", "PU/RC REGULAR CAB", "MODEL C CONVERTIBLE", "PRIUS ELECTRIC HEV", "QUAD CAB EXTENDED CREWMAX", ""]
PICK = {"body": (CARS, 1), "model": (TRUCKS, 2), "drive": (DRIVES, 3), "cab": (CABS, 5), "body_class": (["Pickup", "Hatchback/Liftback", "Wagon", "Coupe", "Sedan/Saloon", "SUV", ""], 7), "series": (["Quad Cab", "Wagon", "", "Double Cab"], 11), "trim": (["Hatch", "SuperCrew", ""], 13), "doors": (["4", "2", ""], 17), "electrification": (["HEV Hybrid", "BEV Electric", ""], 19), "fuel": (["Gasoline", "Electric"], 23), "said": (TEXTS, 29)}
CAR_SQL = "SELECT p_partkey, '' AS second_fuel, " + ", ".join(f"regexp_replace(trim(upper([{', '.join(repr(v) for v in values)}][CAST((p_partkey // {step}) % {len(values)} AS INT) + 1])), '\\s+', ' ', 'g') AS {name}" for name, (values, step) in PICK.items()) + " FROM part"


@query(f"""WITH c AS ({CAR_SQL}), r AS (SELECT p_partkey, list_filter({_score_case(scoring.BODY_RULES, "body")}, lambda x: x IS NOT NULL) AS b, list_filter({_score_case(scoring.DRIVE_RULES, "drive")}, lambda x: x IS NOT NULL) AS d,
      CASE WHEN (contains(body, 'FOUR DOOR SEDAN') OR contains(body, '4 DOOR SEDAN')) AND (contains(said, '2-DR') OR contains(said, '2 DR') OR contains(said, 'COUPE')) THEN 1 ELSE 0 END AS neg4,
      CASE WHEN (contains(body, 'TWO DOOR') OR contains(body, '2 DOOR')) AND (contains(said, '4-DR') OR contains(said, '4 DR') OR contains(said, 'SEDAN')) THEN 1 ELSE 0 END AS neg2, CASE WHEN contains({NAME.format("said")}, {NAME.format("model")}) THEN 1 ELSE 0 END AS named FROM c),
    u AS (SELECT p_partkey, 'b' AS part, x.why, x.t, min(x.i) AS i, any_value(x.n) AS n FROM (SELECT p_partkey, unnest(b) AS x FROM r) GROUP BY 1, 2, 3, 4 UNION ALL SELECT p_partkey, 'd', x.why, x.t, min(x.i), any_value(x.n) FROM (SELECT p_partkey, unnest(d) AS x FROM r) GROUP BY 1, 2, 3, 4
      UNION ALL SELECT p_partkey, 'e', 'neg:2dr-vs-4dr', '', 0, -18 FROM r WHERE neg4 = 1 UNION ALL SELECT p_partkey, 'f', 'neg:4dr-vs-2dr', '', 0, -18 FROM r WHERE neg2 = 1 UNION ALL SELECT p_partkey, 'g', 'model_text+4', '', 0, 4 FROM r WHERE named = 1)
    SELECT part.p_partkey, CAST(coalesce(sum(n), 0) + CASE WHEN part.p_partkey % 3 = 0 THEN 2 WHEN part.p_partkey % 3 = 1 THEN 3 ELSE 0 END AS INTEGER) AS score, coalesce(string_agg(why, ',' ORDER BY part, i), '') AS reasons FROM part LEFT JOIN u ON u.p_partkey = part.p_partkey GROUP BY 1""".replace("ORDER BY part, i", "ORDER BY u.part, i"))
def weighted_tokens(spark, d):
    """Scores and reasons of descriptions by what is known of body, cab, drive and fuel."""
    k = F.col("p_partkey")
    known = {name: F.element_at(F.array(*map(F.lit, values)), (F.floor(k / step) % len(values)).cast("int") + 1) for name, (values, step) in PICK.items()}
    said = known.pop("said")
    out = scoring.scored(t(spark, d, "part").select("p_partkey"), known, said, F.when(k % 3 == 0, "direct").when(k % 3 == 1, "vpic_model").otherwise("list"))
    return out.select("p_partkey", "score", F.array_join("reasons", ",").alias("reasons"))


PATHS = ["vehicle.testNo", "a.rowId", "photoUrl", "videos", "commentary", "vehicleSpeed", "timeIncrement", "sensorType", "occupant.occupantLocation", "modelYear", "scope.makeName", "semantic.hash", "plain", "vehicleWidth"]
PATH_SQL = f"[{', '.join(repr(p) for p in PATHS)}][CAST(event_id % {len(PATHS)} AS INT) + 1]"


def _any(text_, tokens):
    return "(" + " OR ".join(f"contains({text_}, '{x}')" for x in tokens) + ")"


@query(f"""SELECT path, CASE WHEN conflict AND {_any("whole", audit.IDENTITY)} THEN 'P0:semantic_key_candidate' WHEN k = 1 OR k = 2 THEN 'P3:raw_only_no_action' WHEN name IN ({", ".join(repr(x) for x in audit.IDENTIFIERS)}) OR regexp_matches(name, '(url|hash|path|id)$') THEN 'P3:identifier_no_action'
      WHEN {_any("name", audit.COMMENTS)} THEN 'P3:raw_only_no_action' WHEN conflict THEN 'P1:conflict_resolution_candidate' WHEN {_any("name", audit.MEASUREMENTS)} THEN 'P2:numeric_measurement_column_candidate' WHEN {_any("name", audit.DOMAINS)} THEN 'P2:code_values_candidate'
      ELSE 'P2:dictionary_candidate' END AS recommendation, count(*) AS n FROM (SELECT *, lower(path) AS whole, lower(regexp_extract(path, '[^.]*$')) AS name, event_id % 5 AS k, event_id % 7 = 0 AS conflict FROM (SELECT event_id, {PATH_SQL} AS path FROM events)) GROUP BY 1, 2""")
def field_recommendations(spark, d):
    """What to do with fields by what their paths say, beside what is known of them; the rest column comes before identifiers."""
    k, path = F.col("event_id"), F.element_at(F.array(*map(F.lit, PATHS)), (F.col("event_id") % len(PATHS)).cast("int") + 1)
    yes = F.lit(True)
    e = t(spark, d, "events").select("event_id", path.alias("path"))
    rec = audit.recommendation(yes, F.lit(1.0), F.lit(1.0), F.lit(5), F.lit(0.1), mapped=k % 5 == 1, extra=k % 5 == 2, conflict=k % 7 == 0, engineering=~yes, **audit.field_flags(F.col("path")))
    return e.select("path", rec.alias("recommendation")).groupBy("path", "recommendation").agg(F.count(F.lit(1)).alias("n"))


@query("""WITH r AS (SELECT o_orderkey, CAST(year(o_orderdate) AS INTEGER) AS y, o_orderdate, row_number() OVER (PARTITION BY year(o_orderdate) ORDER BY o_orderdate, o_orderkey) - 1 AS k FROM orders)
    SELECT o_orderkey, y AS year FROM (SELECT *, k + CASE y WHEN 1995 THEN -30 WHEN 1996 THEN -10 WHEN 1997 THEN 15 ELSE 0 END AS lv FROM r) ORDER BY lv, o_orderdate, o_orderkey LIMIT 200""")
def quota_pick(spark, d):
    o = t(spark, d, "orders").select("o_orderkey", F.year("o_orderdate").alias("year"), "o_orderdate")
    return details.quota_pick(o, "year", ["o_orderdate", "o_orderkey"], {1995: 30, 1996: 20}, {1996: 10, 1997: 15}, 200).select("o_orderkey", "year")
