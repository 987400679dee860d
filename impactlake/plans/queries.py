"""The engine's operators on a star schema, each with the same result as SQL.

An order stands for a test, its line items for vehicles or source rows, the return flag for an endpoint,
the part for make (brand), model (name) and year (size), a page for an asset, an event for a payload."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import dates, numbers, presence, ratings, text, vehicles
from ..operators import audit, canonical, ingest, linkage, merge, planning, readmodel

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f):
        name = f.__name__.strip("_")
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return register


def t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def lines(spark, d, how: str | None = None) -> DataFrame:
    """Line items with brand, name and size of their part; how: a join hint for the parts."""
    part = t(spark, d, "part").select("p_partkey", "p_brand", "p_name", "p_size", "p_type")
    return t(spark, d, "lineitem").join(part.hint(how) if how else part, F.col("l_partkey") == F.col("p_partkey"))


L = "lineitem JOIN part ON l_partkey = p_partkey"
PRIO = "CASE l_returnflag WHEN 'R' THEN 0 WHEN 'A' THEN 1 ELSE 2 END"
CENTS = "CAST(round({} * 100) AS BIGINT)"


def prio():
    return F.when(F.col("l_returnflag") == "R", 0).when(F.col("l_returnflag") == "A", 1).otherwise(2)


def cents(c):
    return F.round(F.col(c) * 100).cast("long")


# --- filters and lists -------------------------------------------------------------------------------------------


@query("SELECT o_orderkey, CAST(o_orderdate AS DATE) AS test_date FROM orders WHERE CAST(o_orderdate AS DATE) >= DATE '1997-01-01'")
def scope_filter(spark, d):
    o = t(spark, d, "orders").select("o_orderkey", F.col("o_orderdate").cast("date").alias("test_date"))
    return o.where(dates.in_scope(F.col("test_date"), F.lit("parsed"), "1997-01-01"))


@query("""SELECT o_custkey AS test_no, min(CAST(o_orderdate AS DATE)) AS date,
    CASE WHEN min(CAST(o_orderdate AS DATE)) >= DATE '1996-01-01' THEN 'in_scope' ELSE 'out_of_scope' END AS status FROM orders GROUP BY 1""")
def scope_decision(spark, d):
    o = t(spark, d, "orders").select(F.col("o_custkey").alias("test_no"), F.col("o_orderdate").cast("date").alias("test_date"), F.lit("parsed").alias("test_date_status"))
    return canonical.scope_decisions(o, "1996-01-01")


@query("""SELECT o_orderkey, c_name, o_orderpriority FROM orders JOIN customer ON o_custkey = c_custkey
    WHERE o_orderstatus = 'F' AND c_mktsegment = 'BUILDING' ORDER BY o_orderkey LIMIT 50 OFFSET 20""")
def list_filter_page(spark, d):
    o = t(spark, d, "orders").join(t(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    return readmodel.list_page(o, {"o_orderstatus": "F", "c_mktsegment": "BUILDING", "o_orderpriority": ""}, {}, ["o_orderkey"], 20, 50).select("o_orderkey", "c_name", "o_orderpriority")


def order_summary(spark, d) -> DataFrame:
    base = t(spark, d, "orders").select("o_orderkey", "o_orderpriority", "o_orderstatus")
    children = lines(spark, d).withColumnRenamed("l_orderkey", "o_orderkey")
    return readmodel.summary(base, children, "o_orderkey", "p_size", {"makes": "p_brand", "models": "p_name", "kinds": "l_returnflag"}, F.col("l_returnflag") == "R", "has_returns")


@query(f"""SELECT o_orderkey, min(p_size) AS p_size_min, max(p_size) AS p_size_max, coalesce(array_to_string(list_sort(list_distinct(list(p_brand))), ','), '') AS makes,
    coalesce(bool_or(l_returnflag = 'R'), false) AS has_returns FROM orders LEFT JOIN ({L}) ON l_orderkey = o_orderkey GROUP BY 1""")
def filter_summary(spark, d):
    return order_summary(spark, d).select("o_orderkey", "p_size_min", "p_size_max", F.array_join("makes", ",").alias("makes"), "has_returns")


@query(f"SELECT DISTINCT o_orderkey, o_orderpriority FROM orders JOIN ({L}) ON l_orderkey = o_orderkey WHERE p_brand = 'Brand#12'")
def array_filter(spark, d):
    return order_summary(spark, d).where(F.array_contains("makes", "Brand#12")).select("o_orderkey", "o_orderpriority")


@query("SELECT l_orderkey, l_linenumber, l_returnflag FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'P') AND l_returnflag IN ('A', 'R')")
def exclude_manifests(spark, d):
    gone = t(spark, d, "orders").where("o_orderstatus = 'P'").select(F.col("o_orderkey").alias("l_orderkey"))
    return t(spark, d, "lineitem").where(F.col("l_returnflag").isin("A", "R")).join(gone, "l_orderkey", "left_anti").select("l_orderkey", "l_linenumber", "l_returnflag")


# --- facets and read models ---------------------------------------------------------------------------------------


@query("""SELECT facet_name, facet_value, count(*) AS facet_count FROM (SELECT 'o_orderpriority' AS facet_name, o_orderpriority AS facet_value FROM orders
    UNION ALL SELECT 'o_orderstatus', o_orderstatus FROM orders) GROUP BY 1, 2""")
def facets_scalar(spark, d):
    return readmodel.facets(t(spark, d, "orders"), ["o_orderpriority", "o_orderstatus"])


FACETS_ARRAY = f"""SELECT 'makes' AS facet_name, p_brand AS facet_value, count(DISTINCT l_orderkey) AS facet_count FROM {L} JOIN orders ON o_orderkey = l_orderkey GROUP BY 2
    UNION ALL SELECT 'models', p_name, count(DISTINCT l_orderkey) FROM {L} JOIN orders ON o_orderkey = l_orderkey GROUP BY 2"""


@query(FACETS_ARRAY)
def facets_array(spark, d):
    return readmodel.facets(order_summary(spark, d), [], ["makes", "models"])


@query(f"""SELECT 'p_size' AS facet_name, CAST(p_size AS VARCHAR) AS facet_value, count(DISTINCT l_orderkey) AS facet_count FROM {L} GROUP BY 2
    UNION ALL SELECT 'l_linestatus', l_linestatus, count(DISTINCT l_orderkey) FROM {L} GROUP BY 2""")
def facets_distinct(spark, d):
    return readmodel.facets_distinct(lines(spark, d), "l_orderkey", ["p_size", "l_linestatus"])


@query(f"""SELECT * FROM (SELECT facet_name, facet_value, facet_count, CAST(row_number() OVER (PARTITION BY facet_name ORDER BY facet_count DESC, facet_value) AS INTEGER) AS facet_rank
    FROM ({FACETS_ARRAY})) WHERE facet_rank <= 7""")
def facets_ordered_topk(spark, d):
    return readmodel.top_facets(readmodel.facets(order_summary(spark, d), [], ["makes", "models"]), 7)


@query("SELECT l_orderkey, l_returnflag, count(*) AS asset_count FROM lineitem GROUP BY 1, 2")
def asset_summary(spark, d):
    return readmodel.asset_summary(t(spark, d, "lineitem"), "l_orderkey", "l_returnflag")


ANGLE = "((l_quantity * 17 - 400) % 360 + 360) % 360"
DIRECTION = f"CASE WHEN {ANGLE} <= 45 OR {ANGLE} >= 315 THEN 'frontal' WHEN {ANGLE} >= 135 AND {ANGLE} <= 225 THEN 'rear' ELSE 'side' END"


@query(f"SELECT {DIRECTION} AS direction, count(*) AS n FROM lineitem GROUP BY 1")
def impact_direction(spark, d):
    return t(spark, d, "lineitem").select(readmodel.impact_direction(F.col("l_quantity") * 17 - 400).alias("direction")).groupBy("direction").agg(F.count(F.lit(1)).alias("n"))


@query("""SELECT counterparty, count(*) AS n FROM (SELECT l_orderkey, CASE WHEN bool_or(l_returnflag = 'R') THEN 'barrier' WHEN bool_or(l_returnflag = 'A') THEN 'impactor_vehicle'
    WHEN count(*) >= 2 THEN 'vehicle' ELSE 'unknown' END AS counterparty FROM lineitem GROUP BY 1) GROUP BY 1""")
def counterparty(spark, d):
    kinds = F.collect_set(F.when(F.col("l_returnflag") == "R", "barrier").when(F.col("l_returnflag") == "A", "impactor_vehicle").otherwise("subject_vehicle"))
    by = t(spark, d, "lineitem").groupBy("l_orderkey").agg(kinds.alias("kinds"), F.count(F.lit(1)).alias("n"))
    return by.select(readmodel.counterparty(F.col("kinds"), F.col("n")).alias("counterparty")).groupBy("counterparty").agg(F.count(F.lit(1)).alias("n"))


PART_RULES = [("rings", ["RING"]), ("bolts", ["BOLT"]), ("reds", ["RED", "BLUE"]), ("olds", ["OLD"])]


@query(f"SELECT p_partkey, {canonical.cascade_sql('upper(p_name)', PART_RULES, chr(39) + 'needs_review' + chr(39))} AS family FROM part")
def family_cascade(spark, d):
    return t(spark, d, "part").select("p_partkey", canonical.cascade(F.upper("p_name"), PART_RULES, "needs_review").alias("family"))


TAXONOMY = [("STANDARD", "Common"), ("ECONOMY", "Common"), ("PROMO", "Offer"), ("SMALL", "Size"), ("MEDIUM", "Size"), ("LARGE", "Size")]


@query("""SELECT CASE WHEN p_type IN ('STANDARD', 'ECONOMY') THEN 'Common' WHEN p_type = 'PROMO' THEN 'Offer' ELSE 'Size' END AS group_name,
    CAST(CASE WHEN p_type IN ('STANDARD', 'ECONOMY') THEN 0 WHEN p_type = 'PROMO' THEN 1 ELSE 2 END AS INTEGER) AS group_order, count(*) AS group_count FROM part GROUP BY 1, 2""")
def taxonomy_groups(spark, d):
    return readmodel.taxonomy_groups(readmodel.facets(t(spark, d, "part"), ["p_type"]), TAXONOMY, spark)


URL_PATH = r"regexp_replace(regexp_replace(url, '[?#].*$', ''), '^[A-Za-z][A-Za-z0-9+.-]*://[^/]*', '')"
ASSET_TEXT = "lower(url || ' ' || '')"


@query(f"""SELECT page_id, nullif(split_part({URL_PATH}, '/', -1), '') AS filename, {canonical.cascade_sql(ASSET_TEXT, canonical.SUBTYPES, "'UNKNOWN'")} AS subtype,
    {canonical.cascade_sql(ASSET_TEXT, canonical.KINDS, f"CASE WHEN {canonical.cascade_sql(ASSET_TEXT, canonical.SUBTYPES, chr(39) + 'UNKNOWN' + chr(39))} IN ('UDS', 'EV', 'ABF', 'ISO', 'TDMS', 'ZIP') THEN 'data_package' WHEN contains({ASSET_TEXT}, 'document') THEN 'document' ELSE 'other' END")} AS kind FROM pages""")
def asset_kind(spark, d):
    u, none = F.col("url"), F.lit(None).cast("string")
    return t(spark, d, "pages").select("page_id", text.filename(u).alias("filename"), canonical.asset_subtype(u, none).alias("subtype"), canonical.asset_kind(u, none).alias("kind"))


@query("""SELECT code_set, display_value, count(*) AS row_count, count(DISTINCT test) AS test_count, min(test) AS first_test,
      replace(replace(replace(upper(trim(display_value)), ' ', '_'), '/', '_'), '-', '_') AS normalized_value
    FROM (SELECT 'event_type' AS code_set, event_type AS display_value, user_id AS test FROM events UNION ALL SELECT 'source', source, doc_id % 97 FROM documents
      UNION ALL SELECT 'priority', o_orderpriority, o_custkey FROM orders) WHERE display_value IS NOT NULL GROUP BY 1, 2""")
def code_values(spark, d):
    docs = t(spark, d, "documents").withColumn("m", F.col("doc_id") % 97)
    return readmodel.code_values([("event_type", t(spark, d, "events"), "event_type", "user_id"), ("source", docs, "source", "m"), ("priority", t(spark, d, "orders"), "o_orderpriority", "o_custkey")])


# --- raw layer ----------------------------------------------------------------------------------------------------


@query("""WITH f AS (SELECT event_type, 'k' AS field_name, props, CAST(json_extract(props, '$.k') AS VARCHAR) AS example FROM events),
    c AS (SELECT event_type, field_name, count(*) AS seen_count, count(example) AS non_null_count FROM f GROUP BY 1, 2),
    e AS (SELECT event_type, field_name, example, row_number() OVER (PARTITION BY event_type, field_name ORDER BY example) AS n FROM (SELECT DISTINCT event_type, field_name, example FROM f))
    SELECT event_type, field_name, seen_count, non_null_count, (SELECT string_agg(example, '|' ORDER BY n) FROM e WHERE e.event_type = c.event_type AND e.field_name = c.field_name AND n <= 5) AS examples FROM c""")
def field_catalog(spark, d):
    rows = t(spark, d, "events").select(F.col("event_type").alias("endpoint_name"), F.lit("props").alias("section"), F.try_parse_json("props").alias("data"))
    cat = ingest.field_catalog(ingest.field_observations(rows), ["endpoint_name", "field_name"])
    return cat.withColumnRenamed("endpoint_name", "event_type")


@query("""SELECT event_id, CASE WHEN event_id % 5 = 0 THEN 'missing' WHEN event_id % 5 = 1 THEN 'null' WHEN event_id % 5 = 2 THEN 'empty' WHEN event_id % 5 = 3 THEN 'zero' ELSE 'value' END AS state FROM events""")
def json_presence(spark, d):
    m = F.col("event_id") % 5
    body = F.when(m == 0, "{}").when(m == 1, '{"k": null}').when(m == 2, '{"k": ""}').when(m == 3, '{"k": 0}').otherwise(F.col("props").cast("string"))
    fixed = F.when(m == 4, F.concat(F.lit('{"k": 1'), (F.col("event_id") % 10).cast("string"), F.lit("}"))).otherwise(body)
    return t(spark, d, "events").select("event_id", presence.state(F.try_parse_json(fixed), "k").alias("state"))


SAMPLE = "CASE CAST({0} % 8 AS INTEGER) WHEN 0 THEN '1e3' WHEN 1 THEN '' WHEN 2 THEN ' 12.50 ' WHEN 3 THEN '1d' WHEN 4 THEN '1_000' WHEN 5 THEN 'abc' WHEN 6 THEN NULL ELSE CAST({0} AS VARCHAR) END"


def sample(c):
    m = F.col(c) % 8
    return F.when(m == 0, "1e3").when(m == 1, "").when(m == 2, " 12.50 ").when(m == 3, "1d").when(m == 4, "1_000").when(m == 5, "abc").when(m == 6, F.lit(None)).otherwise(F.col(c).cast("string"))


@query("""SELECT event_id, CASE WHEN m = 6 THEN 'null' WHEN m = 1 THEN 'empty' WHEN m IN (3, 5) THEN 'invalid' ELSE 'parsed' END AS status,
    CASE m WHEN 0 THEN 1000.0::DOUBLE WHEN 2 THEN 12.5::DOUBLE WHEN 4 THEN 1000.0::DOUBLE WHEN 7 THEN CAST(event_id AS DOUBLE) END AS number FROM (SELECT event_id, event_id % 8 AS m FROM events)""")
def number_status(spark, d):
    s = sample("event_id")
    return t(spark, d, "events").select("event_id", numbers.number_status(s).alias("status"), numbers.number_value(s).alias("number"))


@query("""SELECT o_orderkey, CASE WHEN m = 0 THEN 'parsed' WHEN m = 1 THEN 'partial' WHEN m = 2 THEN 'invalid' WHEN m = 3 THEN 'empty' WHEN m = 4 THEN 'null' ELSE 'invalid' END AS status,
    CASE WHEN m = 0 THEN CAST(o_orderdate AS DATE) END AS date FROM (SELECT *, o_orderkey % 6 AS m FROM orders)""")
def date_status(spark, d):
    m = F.col("o_orderkey") % 6
    s = F.when(m == 0, F.date_format("o_orderdate", "yyyy-MM-dd")).when(m == 1, "1979").when(m == 2, "not-a-date").when(m == 3, "").when(m == 4, F.lit(None)).otherwise("2016-13-40")
    return t(spark, d, "orders").select("o_orderkey", dates.date_status(s).alias("status"), dates.date_value(s).alias("date"))


@query(r"""SELECT conv_id, turn, nullif(trim(regexp_replace(replace(upper(text), 'ẞ', 'SS'), '\s+', ' ', 'g')), '') AS normal FROM conversations""")
def normalize_text(spark, d):
    return t(spark, d, "conversations").select("conv_id", "turn", text.normalize_text(F.col("text")).alias("normal"))


@query("SELECT p_partkey, sha256('make=' || upper(p_brand) || '|model=' || upper(p_name) || '|year=' || CAST(p_size AS VARCHAR)) AS semantic_key FROM part")
def semantic_hash(spark, d):
    return t(spark, d, "part").select("p_partkey", text.semantic_hash(make=F.col("p_brand"), model=F.col("p_name"), year=F.col("p_size")).alias("semantic_key"))


@query("SELECT sha256(text) AS payload_hash, min(doc_id) AS first_id, count(*) AS observation_count, max(doc_id) AS last_id FROM documents GROUP BY 1")
def payload_dedupe(spark, d):
    docs = t(spark, d, "documents").select("doc_id", text.sha256(F.col("text")).alias("payload_hash"))
    fresh = ingest.new_payloads(docs, key=["payload_hash"], order=["doc_id"]).select("payload_hash", F.col("doc_id").alias("first_id"))
    seen = ingest.observation_counts(docs, ["payload_hash"], "doc_id").select("payload_hash", "observation_count", F.col("last_seen").alias("last_id"))
    return fresh.join(seen, "payload_hash")


@query("""SELECT code, count(*) AS n, sum(v)::BIGINT AS total_cents FROM (SELECT 'l_quantity' AS code, round(l_quantity * 100)::BIGINT AS v FROM lineitem
    UNION ALL SELECT 'l_discount', round(l_discount * 100)::BIGINT FROM lineitem UNION ALL SELECT 'l_tax', round(l_tax * 100)::BIGINT FROM lineitem) GROUP BY 1""")
def unpivot_metrics(spark, d):
    each = t(spark, d, "lineitem").select("l_quantity", "l_discount", "l_tax").unpivot([], ["l_quantity", "l_discount", "l_tax"], "code", "v")
    return each.groupBy("code").agg(F.count(F.lit(1)).alias("n"), F.sum(F.round(F.col("v") * 100).cast("long")).alias("total_cents"))


# --- duplicates, merge, links -------------------------------------------------------------------------------------


@query("SELECT l_orderkey, l_linenumber, count(*) AS row_count FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1")
def dup_groups(spark, d):
    return audit.duplicate_groups(t(spark, d, "lineitem"), ["l_orderkey", "l_linenumber"])


@query("""SELECT 'lineitem' AS table_name, count(*) AS group_count, coalesce(sum(n), 0)::BIGINT AS duplicate_rows FROM (SELECT count(*) AS n FROM lineitem GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1)
    UNION ALL SELECT 'part', count(*), coalesce(sum(n), 0)::BIGINT FROM (SELECT count(*) AS n FROM part GROUP BY p_brand, p_name, p_size HAVING count(*) > 1)
    UNION ALL SELECT 'orders', count(*), coalesce(sum(n), 0)::BIGINT FROM (SELECT count(*) AS n FROM orders GROUP BY o_orderkey HAVING count(*) > 1)""")
def dup_summary(spark, d):
    return audit.duplicate_summary({"lineitem": (t(spark, d, "lineitem"), ["l_orderkey", "l_linenumber"]), "part": (t(spark, d, "part"), ["p_brand", "p_name", "p_size"]), "orders": (t(spark, d, "orders"), ["o_orderkey"])})


@query("""WITH g AS (SELECT l_orderkey, l_linenumber, count(*) AS row_count FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1 ORDER BY 1, 2 LIMIT 25)
    SELECT l_orderkey, l_linenumber, row_count, string_agg(s, ',' ORDER BY s) AS sources FROM (SELECT DISTINCT g.l_orderkey, g.l_linenumber, row_count, CAST(l_suppkey AS VARCHAR) AS s
      FROM g JOIN lineitem i ON g.l_orderkey = i.l_orderkey AND g.l_linenumber = i.l_linenumber) GROUP BY 1, 2, 3""")
def dup_details(spark, d):
    return audit.duplicate_details(t(spark, d, "lineitem"), ["l_orderkey", "l_linenumber"], "l_suppkey", 25)


def merge_rows(spark, d) -> DataFrame:
    """Source rows of entities (order, line number): arrival by ship date; some values are missing."""
    qty = F.when(F.col("l_suppkey") % 4 != 0, cents("l_quantity"))
    return t(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_shipdate", "l_partkey", "l_suppkey", cents("l_extendedprice").alias("price"), prio().alias("prio"), qty.alias("qty"), F.col("l_linestatus").alias("status"))


MERGE_ORDER = ["l_shipdate", "l_partkey", "l_suppkey", "price"]
MERGE_SQL = f"""m AS (SELECT l_orderkey, l_linenumber, l_shipdate, l_partkey, l_suppkey, round(l_extendedprice * 100)::BIGINT AS price, {PRIO} AS prio,
      CASE WHEN l_suppkey % 4 <> 0 THEN round(l_quantity * 100)::BIGINT END AS qty, l_linestatus AS status FROM lineitem),
    o AS (SELECT *, row_number() OVER w AS n, first_value(prio) OVER w AS p1, first_value(l_suppkey) OVER w AS s1 FROM m WINDOW w AS (PARTITION BY l_orderkey, l_linenumber ORDER BY l_shipdate, l_partkey, l_suppkey, price))"""


@query(f"""WITH {MERGE_SQL} SELECT l_orderkey, l_linenumber, coalesce(arg_max(qty, n) FILTER (prio < p1 AND qty IS NOT NULL), arg_min(qty, n) FILTER (qty IS NOT NULL)) AS qty,
    coalesce(arg_max(status, n) FILTER (prio < p1), arg_min(status, n)) AS status, count(*) AS source_rows FROM o GROUP BY 1, 2""")
def merge_fold(spark, d):
    return merge.fold(merge_rows(spark, d), ["l_orderkey", "l_linenumber"], ["qty", "status"], MERGE_ORDER, "prio")


@query(f"""WITH {MERGE_SQL}, b AS (SELECT *, coalesce(last_value(CASE WHEN prio < p1 THEN qty END IGNORE NULLS) OVER w, first_value(qty IGNORE NULLS) OVER w) AS cq,
        coalesce(last_value(CASE WHEN prio < p1 THEN status END IGNORE NULLS) OVER w, first_value(status IGNORE NULLS) OVER w) AS cs FROM o
      WINDOW w AS (PARTITION BY l_orderkey, l_linenumber ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
    c AS (SELECT l_orderkey, l_linenumber, n, s1 AS source_a, l_suppkey AS source_b, 'qty' AS field, CAST(cq AS VARCHAR) AS "current", CAST(qty AS VARCHAR) AS incoming FROM b WHERE cq <> qty
      UNION ALL SELECT l_orderkey, l_linenumber, n, s1, l_suppkey, 'status', cs, status FROM b WHERE cs <> status)
    SELECT l_orderkey, l_linenumber, source_a, source_b, field, "current", incoming FROM c QUALIFY row_number() OVER (PARTITION BY l_orderkey, l_linenumber, field, source_a, source_b ORDER BY n) = 1""")
def merge_conflicts(spark, d):
    return merge.conflicts(merge_rows(spark, d), ["l_orderkey", "l_linenumber"], ["qty", "status"], MERGE_ORDER, "prio", "l_suppkey")


@query("SELECT DISTINCT l_orderkey, l_linenumber, l_suppkey, l_returnflag FROM lineitem")
def row_sources(spark, d):
    return merge.row_sources(t(spark, d, "lineitem"), ["l_orderkey", "l_linenumber"], ["l_suppkey", "l_returnflag"])


@query(f"""WITH r AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, p_brand, p_name, CASE WHEN l_partkey % 3 <> 0 THEN l_partkey END AS no FROM {L}),
    k AS (SELECT p_brand, p_name, arg_min(no, (l_orderkey, l_linenumber, l_partkey, l_suppkey)) AS first_no FROM r WHERE no IS NOT NULL GROUP BY 1, 2)
    SELECT entity, count(*) AS n FROM (SELECT coalesce(CAST(no AS VARCHAR), CAST(first_no AS VARCHAR), r.p_brand || '/' || r.p_name) AS entity FROM r LEFT JOIN k ON r.p_brand = k.p_brand AND r.p_name = k.p_name) GROUP BY 1""")
def entity_fallback(spark, d):
    rows = lines(spark, d).select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "p_brand", "p_name", F.when(F.col("l_partkey") % 3 != 0, F.col("l_partkey")).alias("no"))
    keyed = merge.entity_keys(rows, ["no"], ["p_brand", "p_name"], ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"])
    by = keyed.groupBy("entity_key").agg(F.count(F.lit(1)).alias("n"), F.min("no").alias("no"), F.min("p_brand").alias("b"), F.min("p_name").alias("m"))
    return by.select(F.coalesce(F.col("no").cast("string"), F.concat_ws("/", "b", "m")).alias("entity"), "n")


@query("""SELECT c.l_orderkey, c.l_linenumber, c.l_partkey, coalesce(a.id, b.id) AS parent FROM lineitem c
    LEFT JOIN (SELECT o_orderkey, o_custkey % 7 AS g, min(o_custkey) AS id FROM orders WHERE o_orderstatus = 'F' GROUP BY 1, 2) a ON a.o_orderkey = c.l_orderkey AND a.g = c.l_suppkey % 7
    LEFT JOIN (SELECT o_orderkey, min(o_custkey) AS id FROM orders GROUP BY 1) b ON b.o_orderkey = c.l_orderkey AND c.l_linenumber <= 3""")
def entity_links(spark, d):
    kids = t(spark, d, "lineitem").select(F.col("l_orderkey").alias("test_no"), F.lit(None).cast("int").alias("vehicle_no"), "l_linenumber", "l_partkey", F.concat(F.lit("g"), (F.col("l_suppkey") % 7).cast("string")).alias("near"), F.when(F.col("l_linenumber") <= 3, "any").alias("far"))
    mums = t(spark, d, "orders").select(F.col("o_orderkey").alias("test_no"), F.lit(None).cast("int").alias("vehicle_no"), F.when(F.col("o_orderstatus") == "F", F.concat(F.lit("g"), (F.col("o_custkey") % 7).cast("string"))).alias("p1"), F.lit("any").alias("p2"), F.col("o_custkey").alias("id"))
    out = merge.link(kids, mums, [("near", "p1"), ("far", "p2")], "id", "parent")
    return out.select(F.col("test_no").alias("l_orderkey"), "l_linenumber", "l_partkey", "parent")


# --- joins and sets -----------------------------------------------------------------------------------------------


@query(f"SELECT DISTINCT o_orderkey AS test_no, l_linenumber AS vehicle_no, p_brand AS make, p_name AS model, p_size AS model_year FROM orders JOIN ({L}) ON o_orderkey = l_orderkey WHERE l_returnflag <> 'N' AND o_orderstatus = 'O'")
def subject_join(spark, d):
    rows = lines(spark, d)
    tests = t(spark, d, "orders").where("o_orderstatus = 'O'").select(F.col("o_orderkey").alias("test_no"))
    v = rows.where("l_returnflag <> 'N'").select(F.col("l_orderkey").alias("test_no"), F.col("l_linenumber").alias("vehicle_no"), F.col("p_brand").alias("make"), F.col("p_name").alias("model"), F.col("p_size").alias("model_year"))
    parts = rows.select(F.col("l_orderkey").alias("test_no"), F.col("l_linenumber").alias("vehicle_no"), F.lit("subject_vehicle").alias("kind")).distinct()
    return linkage.subjects(tests, parts, v)


@query("SELECT o_orderkey, 'lineitem' AS endpoint FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)")
def missing_requests(spark, d):
    want = t(spark, d, "orders").select("o_orderkey", F.lit("lineitem").alias("endpoint"))
    return audit.missing(want, t(spark, d, "lineitem").select(F.col("l_orderkey").alias("o_orderkey")), ["o_orderkey"])


@query("SELECT l_orderkey FROM lineitem GROUP BY 1 HAVING bool_or(l_returnflag <> 'N')")
def conditional_anti(spark, d):
    return audit.without_only(t(spark, d, "lineitem"), ["l_orderkey"], "l_returnflag", "N")


@query("""SELECT k AS l_orderkey, CAST(p AS INTEGER) AS l_linenumber FROM (SELECT l_orderkey AS k, unnest(range(1, max(l_linenumber) + 1)) AS p FROM lineitem GROUP BY 1)
    WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = k AND l_linenumber = p)""")
def page_gaps(spark, d):
    return audit.page_gaps(t(spark, d, "lineitem").select("l_orderkey", "l_linenumber"), "l_orderkey", "l_linenumber", 1)


@query("""SELECT coalesce(a.year, b.year) AS year, coalesce(full_count, 0) AS full_count, coalesce(db_count, 0) AS db_count,
    CASE WHEN coalesce(full_count, 0) = 0 THEN 'db_only' WHEN coalesce(db_count, 0) = 0 THEN 'uncovered' WHEN db_count < full_count * 0.1::DOUBLE THEN 'thin' ELSE 'represented' END AS status
    FROM (SELECT CAST(year(o_orderdate) AS INTEGER) AS year, count(*) AS full_count FROM orders GROUP BY 1) a
    FULL JOIN (SELECT CAST(year(l_shipdate) AS INTEGER) AS year, count(*) AS db_count FROM lineitem WHERE l_shipdate >= '1996-06-01' AND l_suppkey = 7 GROUP BY 1) b ON a.year = b.year""")
def coverage_outer(spark, d):
    full = t(spark, d, "orders").select(F.year("o_orderdate").alias("year"))
    ours = t(spark, d, "lineitem").where("l_shipdate >= '1996-06-01' and l_suppkey = 7").select(F.year("l_shipdate").alias("year"))
    return audit.coverage(full, ours, "year")


@query("""SELECT CASE WHEN c IS NULL THEN 'right_only' ELSE 'left_only' END AS side, coalesce(c, o) AS custkey FROM (SELECT DISTINCT c_custkey AS c FROM customer WHERE c_acctbal > 3000)
    FULL JOIN (SELECT DISTINCT o_custkey AS o FROM orders) ON c = o WHERE c IS NULL OR o IS NULL""")
def set_diff(spark, d):
    a = t(spark, d, "customer").where("c_acctbal > 3000").select(F.col("c_custkey").alias("custkey"))
    return planning.set_differences(a, t(spark, d, "orders").select(F.col("o_custkey").alias("custkey")), "custkey")


@query("""SELECT count(*) FILTER (c IS NOT NULL AND o IS NOT NULL) AS both_count, count(*) FILTER (o IS NULL) AS left_only, count(*) FILTER (c IS NULL) AS right_only,
    round_even(count(*) FILTER (c IS NOT NULL AND o IS NOT NULL)::DOUBLE / count(c), 4) AS overlap_ratio
    FROM (SELECT DISTINCT c_custkey AS c FROM customer) FULL JOIN (SELECT DISTINCT o_custkey AS o FROM orders WHERE o_orderstatus = 'F' AND o_orderdate < '1995-09-01') ON c = o""")
def set_overlap(spark, d):
    a = t(spark, d, "customer").select(F.col("c_custkey").alias("k"))
    b = t(spark, d, "orders").where("o_orderstatus = 'F' and o_orderdate < '1995-09-01'").select(F.col("o_custkey").alias("k"))
    return audit.overlap(a, b, ["k"])


@query("""SELECT k, count(*) AS slice_count FROM (SELECT DISTINCT o_custkey AS k, year(o_orderdate) AS y FROM orders WHERE year(o_orderdate) IN (1995, 1996, 1997)) GROUP BY 1""")
def slice_union(spark, d):
    o = t(spark, d, "orders").select(F.col("o_custkey").alias("k"), F.year("o_orderdate").alias("y"))
    return planning.slice_union([o.where(F.col("y") == y).select("k").distinct() for y in (1995, 1996, 1997)], "k")


@query(r"SELECT page_id, url FROM pages WHERE url LIKE '%page=%' AND NOT regexp_matches(url, '/(en|de)/')")
def invariant_check(spark, d):
    p = t(spark, d, "pages").select("page_id", "url")
    return audit.missing(p.where(F.col("url").contains("page=")), p.where(F.col("url").rlike("/(en|de)/")), ["page_id"])


# --- audits -------------------------------------------------------------------------------------------------------


@query("""SELECT l_orderkey, count(*) AS row_count, count(DISTINCT (l_linenumber, l_returnflag)) AS slot_count,
    CASE WHEN count(*) = count(DISTINCT (l_linenumber, l_returnflag)) THEN 'one_row_per_slot' ELSE 'multiple_rows_per_slot' END AS status FROM lineitem GROUP BY 1""")
def slot_cardinality(spark, d):
    return audit.slot_cardinality(t(spark, d, "lineitem"), "l_orderkey", ["l_linenumber", "l_returnflag"])


@query("SELECT event_type AS value, count(*) AS count FROM events GROUP BY 1 ORDER BY 2 DESC, 1")
def counter_rows(spark, d):
    return audit.ordered(audit.counter_rows(t(spark, d, "events"), "event_type"), F.desc("count"), "value")


PROFILE = """WITH f AS (SELECT event_type, user_id, CASE WHEN event_id % 9 = 0 THEN 'STRING' ELSE 'BIGINT' END AS observed_type, event_id % 4 <> 0 AS non_null FROM events),
    b AS (SELECT event_type, observed_type, count(*) AS n, count(*) FILTER (non_null) AS filled FROM f GROUP BY 1, 2),
    p AS (SELECT event_type, sum(n)::BIGINT AS seen_count, sum(filled)::BIGINT AS filled_count, (SELECT count(DISTINCT user_id) FROM f WHERE f.event_type = b.event_type) AS test_count,
      round_even(sum(filled)::DOUBLE / sum(n), 4) AS filled_ratio, round_even(max(n)::DOUBLE / sum(n), 4) AS type_stability FROM b GROUP BY 1)"""


def profile(spark, d) -> DataFrame:
    obs = t(spark, d, "events").select("event_type", "user_id", F.when(F.col("event_id") % 9 == 0, "STRING").otherwise("BIGINT").alias("observed_type"), (F.col("event_id") % 4 != 0).alias("non_null"))
    return audit.field_profile(obs, ["event_type"], "user_id")


@query(PROFILE + " SELECT * FROM p")
def field_profile(spark, d):
    return profile(spark, d)


@query(PROFILE + """ SELECT event_type, round_even(0.3::DOUBLE * least(test_count / 200.0::DOUBLE, 1.0) + 0.2::DOUBLE * filled_ratio + 0.2::DOUBLE * type_stability + 0.1::DOUBLE * (1.0 - least(0.25::DOUBLE, 1.0))
    + CASE WHEN event_type = 'error' THEN 0.2::DOUBLE ELSE 0.0 END - CASE WHEN event_type = 'view' THEN 0.3::DOUBLE ELSE 0.0 END - 0.0, 4) AS score,
    CASE WHEN event_type = 'signup' THEN 'P3:raw_only_no_action' WHEN event_type = 'view' THEN 'P1:conflict_resolution_candidate' WHEN type_stability < 0.95 THEN 'P2:requires_manual_review'
         WHEN event_type = 'error' THEN 'P1:column_candidate' ELSE 'P2:column_candidate' END AS recommendation FROM p""")
def promotion_score(spark, d):
    p, e, no = profile(spark, d), F.col("event_type"), F.lit(False)
    score = audit.promotion_score(F.col("test_count") / 200.0, F.col("filled_ratio"), F.col("type_stability"), F.lit(0.25), e == "error", e == "view", no)
    flags = {"semantic": no, "mapped": e == "signup", "raw_only": no, "identifier": no, "conflict": e == "view", "numeric": no, "domain": no, "facet": no, "engineering": e == "error"}
    rec = audit.recommendation(F.col("test_count") >= 5, F.col("filled_ratio"), F.col("type_stability"), F.lit(1), F.lit(1.0), **flags)
    return p.select("event_type", F.bround(score, 4).alias("score"), rec.alias("recommendation"))


@query("""SELECT class, count(*) AS n FROM (SELECT CASE CAST(l_linenumber AS INTEGER) WHEN 1 THEN 'P0:semantic_conflict' WHEN 2 THEN 'P3:benign_alias_difference' WHEN 3 THEN CASE WHEN l_quantity = l_suppkey THEN 'P3:numeric_rounding_difference' ELSE 'P3:unit_representation_difference' END
    WHEN 4 THEN CASE WHEN l_quantity = l_suppkey THEN 'P3:numeric_rounding_difference' ELSE 'P1:canonical_resolution_needed' END ELSE CASE WHEN l_quantity = l_suppkey THEN 'P3:numeric_rounding_difference' ELSE 'P2:requires_manual_review' END END AS class FROM lineitem) GROUP BY 1""")
def conflict_taxonomy(spark, d):
    n = F.col("l_linenumber")
    name = F.when(n == 1, "test_date").when(n == 2, "occupant_location").when(n == 3, "vehicle_speed").when(n == 4, "test_configuration").otherwise("axis")
    a = F.when(n == 2, "DRIVER").otherwise(F.col("l_quantity").cast("string"))
    rows = t(spark, d, "lineitem").select(audit.conflict_class(name, a, F.col("l_suppkey").cast("string")).alias("class"))
    return rows.groupBy("class").agg(F.count(F.lit(1)).alias("n"))


VALUES = "SELECT 'o_orderpriority' AS field, o_orderpriority AS value FROM orders UNION ALL SELECT 'o_custkey', CAST(o_custkey AS VARCHAR) FROM orders UNION ALL SELECT 'o_orderstatus', o_orderstatus FROM orders"


@query(f"""WITH c AS (SELECT field, value, count(*) AS n FROM ({VALUES}) GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY field ORDER BY n DESC, value) AS k FROM c)
    SELECT field, sum(n)::BIGINT AS filled_count, count(*) AS distinct_count, string_agg(value || '=' || n, '; ' ORDER BY k) FILTER (k <= 12) AS top_values FROM r GROUP BY 1""")
def value_profile(spark, d):
    return audit.value_profile(t(spark, d, "orders"), ["o_orderpriority", "o_custkey", "o_orderstatus"])


SIZES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events")


@query(" UNION ALL ".join(f"SELECT '{n}' AS table_name, count(*) AS row_count, CAST(round_even(count(*) * (3891.0::DOUBLE / 1500), 0) AS BIGINT) AS estimated_rows FROM {n}" for n in SIZES))
def capacity(spark, d):
    return audit.capacity(audit.table_counts({n: t(spark, d, n) for n in SIZES}), 1500, 3891)


@query("SELECT table_name, estimated_rows, CASE WHEN estimated_rows > 5000000 THEN 'sqlite_possible_but_postgresql_preferred_for_lineage_queries' ELSE 'sqlite_possible_for_full_scale_metadata_only' END AS advice FROM ("
    + " UNION ALL ".join(f"SELECT '{n}' AS table_name, count(*) * 1000 AS estimated_rows FROM {n}" for n in SIZES) + ") WHERE estimated_rows >= 1000000 ORDER BY estimated_rows DESC, table_name LIMIT 10")
def bottlenecks(spark, d):
    counts = audit.table_counts({n: t(spark, d, n) for n in SIZES}).select("table_name", (F.col("row_count") * 1000).alias("estimated_rows"))
    return audit.bottlenecks(counts).select("table_name", "estimated_rows", audit.storage_advice(F.lit(0), F.col("estimated_rows")).alias("advice"))


# --- planning -----------------------------------------------------------------------------------------------------


@query(f"SELECT l_orderkey, l_linenumber, l_suppkey, l_partkey FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY {PRIO}, l_shipdate, l_partkey, l_suppkey) = 1")
def dedupe_priority(spark, d):
    return planning.best_row(t(spark, d, "lineitem"), ["l_orderkey", "l_linenumber"], [prio(), "l_shipdate", "l_partkey", "l_suppkey"]).select("l_orderkey", "l_linenumber", "l_suppkey", "l_partkey")


@query("""SELECT o_orderkey, o_orderpriority FROM (SELECT *, row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_orderkey) AS n FROM orders) WHERE n <= 30 ORDER BY o_orderkey LIMIT 100""")
def stratified_select(spark, d):
    return planning.stratified(t(spark, d, "orders"), "o_orderpriority", 30, ["o_orderkey"], 100).select("o_orderkey", "o_orderpriority")


@query("""SELECT p_partkey, rarity FROM (SELECT p_partkey, count(*) OVER (PARTITION BY p_brand) + count(*) OVER (PARTITION BY p_name) + count(*) OVER (PARTITION BY p_size) AS rarity FROM part) ORDER BY rarity, p_partkey LIMIT 100""")
def rarity_order(spark, d):
    return planning.rarity(t(spark, d, "part").select("p_partkey", "p_brand", "p_name", "p_size"), ["p_brand", "p_name", "p_size"], ["p_partkey"], 100).select("p_partkey", "rarity")


@query("""WITH r AS (SELECT p_brand, p_type, p_partkey, row_number() OVER (PARTITION BY p_brand, p_type ORDER BY p_partkey) AS k FROM part)
    SELECT p_brand, p_type, p_partkey, CAST(row_number() OVER (PARTITION BY p_brand ORDER BY k, p_type) AS INTEGER) AS pick_order FROM r QUALIFY pick_order <= 12""")
def balanced_pick(spark, d):
    return planning.balanced_pick(t(spark, d, "part").select("p_brand", "p_type", "p_partkey"), "p_brand", "p_type", ["p_partkey"], 12)


@query("""SELECT *, sha256(o_orderkey || '|' || o_custkey || '|' || o_orderpriority) AS row_hash FROM (SELECT o_orderkey, o_custkey, o_orderpriority, 'live' AS origin FROM orders WHERE o_orderstatus = 'F'
    UNION ALL SELECT o_orderkey, o_custkey, o_orderpriority, 'validated' FROM orders WHERE o_orderpriority = '1-URGENT' AND o_orderstatus <> 'F')""")
def authoritative_union(spark, d):
    o = t(spark, d, "orders")
    return planning.authoritative(o.where("o_orderstatus = 'F'"), o.where("o_orderpriority = '1-URGENT'"), "o_orderkey", ["o_custkey", "o_orderpriority"])


@query("""SELECT o_orderkey, CASE WHEN o_orderstatus = 'P' THEN 'excluded_not_live_validated' WHEN o_orderkey % 11 = 0 THEN 'excluded_date_missing_or_parse_failed' WHEN o_orderdate < '1996-01-01' THEN 'excluded_out_of_scope'
    WHEN o_orderkey % 7 = 0 THEN 'date_conflict' WHEN o_orderkey % 5 = 0 THEN 'validated_live_with_metadata_drift' ELSE 'validated_live' END AS status FROM orders""")
def validation_status(spark, d):
    k, live = F.col("o_orderkey"), F.col("o_orderdate").cast("date")
    seed = F.when(k % 7 == 0, F.date_add(live, 1)).otherwise(live)
    return t(spark, d, "orders").select("o_orderkey", planning.validation_status(seed, F.when(k % 11 != 0, live), F.col("o_orderstatus") != "P", k % 5 == 0, "1996-01-01").alias("status"))


# --- record linkage -----------------------------------------------------------------------------------------------

SCORE = "(CASE WHEN a.p_name = b.p_name THEN 20 ELSE 0 END + CASE WHEN a.p_size = b.p_size THEN 5 ELSE 0 END + CASE WHEN abs(a.p_size - b.p_size) <= 2 THEN 10 ELSE 0 END)"
EVERY = f"""WITH s AS (SELECT a.p_partkey AS subject, b.p_partkey AS candidate, b.p_name AS signature, CAST({SCORE} AS INTEGER) AS score FROM part a JOIN part b ON a.p_brand = b.p_brand AND a.p_type = b.p_type AND a.p_partkey <> b.p_partkey
      WHERE {SCORE} >= 5),
    k AS (SELECT *, CAST(row_number() OVER (PARTITION BY subject ORDER BY score DESC, candidate) AS INTEGER) AS candidate_rank FROM s"""
RANKED = EVERY + " QUALIFY candidate_rank <= 8)"
CONF = """c AS (SELECT subject, count(*) AS candidate_count, max(score) FILTER (candidate_rank = 1) AS top_score, max(score) FILTER (candidate_rank = 2) AS second_score FROM k GROUP BY 1),
    f AS (SELECT *, CASE WHEN candidate_count = 1 THEN 'HIGH_SINGLE_VARIANT' WHEN (top_score >= 25 AND top_score - second_score >= 10) OR (top_score >= 12 AND top_score - second_score >= 5) THEN 'HIGH_DISAMBIGUATED'
      WHEN top_score > 0 AND top_score - second_score >= 1 THEN 'MEDIUM_RANKED' ELSE 'REVIEW_AMBIGUOUS_VARIANT' END AS confidence FROM c)"""


def sides(spark, d) -> tuple[DataFrame, DataFrame]:
    p = t(spark, d, "part").select("p_partkey", "p_brand", "p_name", "p_type", "p_size")
    return p.toDF("subject", "p_brand", "an", "p_type", "asz"), p.toDF("candidate", "p_brand", "bn", "p_type", "bsz")


def ranked(spark, d) -> DataFrame:
    a, b = sides(spark, d)
    size, near = F.col("bsz").cast("string"), [(F.col("asz").cast("long") + n).cast("string") for n in (-2, -1, 1, 2)]
    own = F.col("asz").cast("string")
    # the same name gives 20, sizes at most 2 apart 10, equal ones 5 more
    ways = [
        (F.array(F.array("an")), F.array("bn"), 20), (F.array(*[F.array(x) for x in near]), F.array(size), 10), (F.array(F.array(own)), F.array(size), 15),
        (F.array(*[F.array("an", x) for x in near]), F.array("bn", size), 30), (F.array(F.array("an", own)), F.array("bn", size), 35),
    ]
    out = linkage.best_candidates(a, b, ["p_brand", "p_type"], ways, 5, ["subject"], ["candidate"], 8, ["an", "asz"], ("subject", "candidate"))
    return out.select("subject", "candidate", F.col("bn").alias("signature"), "score", "candidate_rank")


@query(RANKED + " SELECT * FROM k")
def candidate_rank(spark, d):
    return ranked(spark, d)


@query(EVERY + "), " + CONF + " SELECT * FROM f")
def confidence(spark, d):
    a, b = sides(spark, d)
    counts = linkage.score_counts(a, b, ["p_brand", "p_type"], ("an", "bn", 20), ("asz", "bsz", [(0, 15), (2, 10)]), 5, ("subject", "candidate"))
    return linkage.confidence_of_counts(counts, "subject")


@query(RANKED + ", " + CONF + """, e AS (SELECT subject, min(signature) AS lo, max(signature) AS hi, count(*) AS n FROM k GROUP BY 1),
    g AS (SELECT k.subject, min(signature) AS lo, max(signature) AS hi, count(*) AS n FROM k JOIN f ON k.subject = f.subject AND k.score = f.top_score GROUP BY 1)
    SELECT f.subject, candidate_count, top_score, second_score, CASE WHEN confidence IN ('MEDIUM_RANKED', 'REVIEW_AMBIGUOUS_VARIANT') AND e.lo = e.hi THEN 'HIGH_EQUIVALENT_RATING'
      WHEN confidence IN ('MEDIUM_RANKED', 'REVIEW_AMBIGUOUS_VARIANT') AND g.n > 1 AND g.n < e.n AND g.lo = g.hi THEN 'HIGH_TOP_EQUIVALENT_RATING' ELSE confidence END AS confidence
    FROM f JOIN e ON f.subject = e.subject JOIN g ON f.subject = g.subject""")
def equivalence(spark, d):
    r = ranked(spark, d)
    return linkage.equivalence(r, "subject", "signature", "score", linkage.confidence(r, "subject"))


@query(RANKED + """, b AS (SELECT subject, candidate, score + CASE WHEN candidate % 4 = 0 THEN 100 ELSE 0 END AS score, candidate_rank AS old FROM k)
    SELECT subject, candidate, score, CAST(row_number() OVER (PARTITION BY subject ORDER BY score DESC, old) AS INTEGER) AS candidate_rank FROM b""")
def evidence_rerank(spark, d):
    return linkage.evidence_rerank(ranked(spark, d), "subject", F.col("candidate") % 4 == 0).select("subject", "candidate", "score", "candidate_rank")


@query(f"SELECT p_partkey, l_suppkey, price FROM (SELECT l_partkey AS p_partkey, l_suppkey, {CENTS.format('l_extendedprice')} AS price, l_orderkey FROM lineitem) QUALIFY row_number() OVER (PARTITION BY p_partkey ORDER BY price DESC, l_suppkey, l_orderkey) = 1")
def variant_argmax(spark, d):
    rows = t(spark, d, "lineitem").select(F.col("l_partkey").alias("p_partkey"), "l_suppkey", cents("l_extendedprice").alias("price"), "l_orderkey")
    return linkage.best_variant(rows, "p_partkey", "price", ["l_suppkey", "l_orderkey"]).select("p_partkey", "l_suppkey", "price")


def authority(spark, d) -> tuple[DataFrame, DataFrame]:
    p = t(spark, d, "part").select("p_partkey", F.when(F.col("p_size") % 2 == 0, "3").otherwise("4").alias("stars"), F.lit("x").alias("tip"))
    m = F.col("p_partkey") % 6
    a = t(spark, d, "part").where("p_type <> 'PROMO'").select("p_partkey", F.when(m == 1, "0").when(m == 2, "5").when(m == 3, "N/A").when(m == 5, "9").otherwise("2").alias("stars"), F.when(m == 1, "No Tip").when(m == 2, "0").otherwise("odd").alias("tip"))
    return p, a


@query("""SELECT p_partkey, CASE WHEN p_type = 'PROMO' THEN s ELSE CASE p_partkey % 6 WHEN 1 THEN 'Not Rated' WHEN 2 THEN '5' WHEN 3 THEN s WHEN 5 THEN s ELSE '2' END END AS stars,
    CASE WHEN p_type = 'PROMO' THEN 'x' ELSE CASE p_partkey % 6 WHEN 1 THEN 'No Tip' WHEN 2 THEN NULL ELSE 'x' END END AS tip FROM (SELECT p_partkey, p_type, CASE WHEN p_size % 2 = 0 THEN '3' ELSE '4' END AS s FROM part)""")
def authority_overwrite(spark, d):
    p, a = authority(spark, d)
    return linkage.overwrite(p, a, "p_partkey", {"stars": "star", "tip": "tip"})


@query("""SELECT p_partkey, CASE WHEN p_type = 'PROMO' THEN 'NO_CSV_MATCH' WHEN p_partkey % 6 = 5 THEN 'REVIEW_CONFLICT' WHEN p_partkey % 6 IN (1, 2) OR (p_partkey % 6 IN (0, 4)) THEN 'READY_OFFICIAL_ENRICHMENT' ELSE 'ALREADY_ALIGNED' END AS status FROM part""")
def adoption_status(spark, d):
    p, a = authority(spark, d)
    j = p.join(a.select("p_partkey", F.col("stars").alias("theirs"), F.lit(True).alias("hit")), "p_partkey", "left")
    apply, value = ratings.authoritative("star", F.col("theirs"))
    return j.select("p_partkey", linkage.adoption_status(F.coalesce("hit", F.lit(False)), ~ratings.is_blank(F.col("theirs")) & ~apply, apply & ~numbers.values_equal(value, F.col("stars"))).alias("status"))


@query("""SELECT p_partkey, p_brand, v FROM (SELECT p_partkey, p_brand, 'old' AS v FROM part WHERE p_size < 30 AND p_partkey NOT IN (SELECT p_partkey FROM part WHERE p_size BETWEEN 20 AND 40)
    UNION ALL SELECT p_partkey, p_brand, 'new2' FROM part WHERE p_size BETWEEN 20 AND 40)""")
def overlay_upsert(spark, d):
    p = t(spark, d, "part")
    old = p.where("p_size < 30").select("p_partkey", "p_brand", F.lit("old").alias("v"))
    one = p.where("p_size between 20 and 40")
    new = one.select("p_partkey", "p_brand", F.lit("new1").alias("v"), F.lit(1).alias("seq")).unionByName(one.select("p_partkey", "p_brand", F.lit("new2").alias("v"), F.lit(2).alias("seq")))
    return linkage.overlay_upsert(old, new, ["p_partkey"], "seq")


@query(RANKED + ", " + CONF + """ SELECT count(*) AS candidate_count, count(DISTINCT k.subject) AS subject_count, count(DISTINCT CASE WHEN candidate_rank = 1 AND confidence LIKE 'HIGH%' THEN k.subject END) AS auto_subjects,
    count(DISTINCT CASE WHEN candidate_rank = 1 AND confidence NOT LIKE 'HIGH%' THEN k.subject END) AS review_subjects FROM k JOIN f ON k.subject = f.subject""")
def overlay_metrics(spark, d):
    r = ranked(spark, d)
    c = linkage.confidence(r, "subject").select("subject", linkage.selection_status(F.col("confidence")).alias("selection_status"))
    return linkage.overlay_metrics(r.join(c, "subject"), "subject")


@query("""SELECT c_custkey, n_name, r_name FROM customer LEFT JOIN (SELECT n_nationkey, n_name, r_name FROM nation JOIN region ON n_regionkey = r_regionkey WHERE n_nationkey < 20) ON n_nationkey = c_nationkey WHERE c_nationkey < 20
    UNION ALL SELECT c_custkey, n_name, r_name FROM customer LEFT JOIN (SELECT n_nationkey, n_name, r_name FROM nation JOIN region ON n_regionkey = r_regionkey) ON n_nationkey = c_nationkey - 20 WHERE c_nationkey >= 20""")
def enrich_fallback(spark, d):
    csv = t(spark, d, "nation").join(t(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey")).where("n_nationkey < 20").select(F.concat(F.lit("n-"), F.col("n_nationkey").cast("string")).alias("k"), "n_name", "r_name")
    c = t(spark, d, "customer").select("c_custkey", F.concat(F.lit("N "), F.col("c_nationkey").cast("string")).alias("k1"), F.concat(F.lit("n"), (F.col("c_nationkey") - 20).cast("string")).alias("k2"))
    return linkage.enrich(c.withColumnRenamed("k1", "k"), csv, ["k"], ["k2"], ["n_name", "r_name"]).select("c_custkey", "n_name", "r_name")


@query("""SELECT p_partkey, array_to_string(list_filter([CASE WHEN contains(u, 'RED') THEN 'red' END, CASE WHEN contains(u, 'RING') OR contains(u, 'BOLT') THEN 'metal' END, CASE WHEN contains(u, 'OLD') THEN 'old' END], lambda x: x IS NOT NULL), ',') AS flags,
    CAST(CASE WHEN contains(u, 'RED') THEN 20 ELSE 0 END + CASE WHEN contains(u, 'RING') THEN 5 ELSE 0 END AS INTEGER) AS score FROM (SELECT p_partkey, upper(p_name) AS u FROM part)""")
def feature_flags(spark, d):
    u = F.upper("p_name")
    flags = text.compact(text.flag("red", u.contains("RED")), text.flag("metal", u.rlike("RING|BOLT")), text.flag("old", u.contains("OLD")))
    return t(spark, d, "part").select("p_partkey", F.array_join(flags, ",").alias("flags"), vehicles.token_score([("red", 20), ("ring", 5), ("RED", 20)], F.col("p_name")).alias("score"))


@query("""SELECT o_orderkey, 'https://api.example/tests/' || o_orderkey || '/vehicles/' || replace(replace(o_orderpriority, ' ', '%20'), '/', '%2F') AS url FROM orders""")
def render_url(spark, d):
    url = text.render_url("https://api.example/tests/{test_no}/vehicles/{vehicle_no}", [], {"test_no": F.col("o_orderkey"), "vehicle_no": F.col("o_orderpriority")})
    return t(spark, d, "orders").select("o_orderkey", url.alias("url"))


@query("""SELECT a.r_name, count(*) AS orders, sum(round(o_totalprice * 100)::BIGINT)::BIGINT AS cents FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region a ON n_regionkey = r_regionkey
    WHERE o_orderdate >= '1996-01-01' AND o_orderdate < '1998-01-01' GROUP BY 1""")
def endpoint_coverage(spark, d):
    o = t(spark, d, "orders").where("o_orderdate >= '1996-01-01' and o_orderdate < '1998-01-01'").select("o_custkey", "o_totalprice")
    c = t(spark, d, "customer").select("c_custkey", "c_nationkey")
    by = o.join(c, F.col("o_custkey") == F.col("c_custkey")).groupBy("c_nationkey").agg(F.count(F.lit(1)).alias("n"), F.sum(cents("o_totalprice")).alias("v"))
    n = t(spark, d, "nation").join(t(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey")).select("n_nationkey", "r_name")
    return by.join(n, F.col("c_nationkey") == F.col("n_nationkey")).groupBy("r_name").agg(F.sum("n").alias("orders"), F.sum("v").alias("cents"))


@query("SELECT CASE i % 3 WHEN 0 THEN 'ACCELEROMETER' WHEN 1 THEN 'LOAD CELL' ELSE 'DISPLACEMENT' END AS sensor_type, count(*) AS n FROM range(1, 635) t(i) GROUP BY 1")
def channel_volume(spark, d):
    """Synthetic channels; nothing of the tables."""
    from ..sources.files import channels

    return channels(spark, 10001).groupBy("sensor_type").agg(F.count(F.lit(1)).alias("n"))


@query("""WITH c AS (SELECT p_brand, p_type, p_partkey, lag(p_type) OVER (PARTITION BY p_brand ORDER BY p_partkey) AS before FROM part)
    SELECT p_brand, p_type, p_partkey, CAST(row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) AS INTEGER) AS pick_order FROM c WHERE before IS NULL OR before <> p_type QUALIFY pick_order <= 40""")
def greedy_pick(spark, d):
    return planning.greedy_pick(t(spark, d, "part").select("p_brand", "p_type", "p_partkey"), "p_brand", "p_type", ["p_partkey"], 40)


def flagship(spark: SparkSession, d: str) -> DataFrame:
    """Summary read model and its facets in one plan."""
    return readmodel.top_facets(readmodel.facets(order_summary(spark, d), ["o_orderpriority", "o_orderstatus"], ["makes", "models", "kinds"]), 20).orderBy("facet_name", "facet_rank")

