"""The taxonomy of crash families on the star schema: a part's key stands for what a test is classified as."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import taxonomy
from .queries import query, t

# families as data has them: all known ones, some other names, some unknown; and categories, some of none
SAID = [*[f for f, *_ in taxonomy.FAMILIES], "frontal", "side pole", "SIDE_MDB_NCAP", "REAR_IMPACT_FMVSS301_MODE", "UNKNOWN", ""]
CATEGORIES = [*[c for _, _, _, _, cs in taxonomy.MODES for c in cs if "301" not in c], " ", "OTHER"]
lists = lambda values: "[" + ", ".join(f"'{v}'" for v in values) + "]"
PARTS = f"SELECT p_partkey, p_container, {lists(SAID)}[CAST(p_partkey % {len(SAID)} AS INT) + 1] AS family, {lists(CATEGORIES)}[CAST((p_partkey // 7) % {len(CATEGORIES)} AS INT) + 1] AS category FROM (SELECT p_partkey, p_type AS p_container FROM part)"


def classified(spark, d):
    pick = lambda values, at: F.element_at(F.array(*map(F.lit, values)), (at % len(values)).cast("int") + 1)
    k = F.col("p_partkey")
    return t(spark, d, "part").select("p_partkey", F.col("p_type").alias("p_container"), pick(SAID, k).alias("family"), pick(CATEGORIES, F.floor(k / 7)).alias("category"))


def table(rows, *names):
    """Rows as a SQL table."""
    cell = lambda x: "NULL" if x is None else lists(x) + "::VARCHAR[]" if isinstance(x, list) else str(x) if isinstance(x, int) else f"'{x}'"
    return f"(SELECT * FROM (VALUES {', '.join('(' + ', '.join(map(cell, r)) + ')' for r in rows)}) AS v({', '.join(names)}))"


MODES_SQL = table([(m, g, i, label, f, c) for i, (m, g, label, f, c) in enumerate(taxonomy.MODES)], "value", "grp", "place", "label", "families", "categories")
GROUPS_SQL = table(list(enumerate(taxonomy.GROUPS)), "place", "value")
LABELS_SQL = table(list(taxonomy.LABEL_OF.items()), "k", "label")
# the steps one after another, each in SQL of its own: old names, modes, their other names, families
NAMES_SQL = table(
    [*[(n, g, 0) for n, g in taxonomy.OLD_NAMES], *[(m, g, 1) for m, g, *_ in taxonomy.MODES], *[(n, next(g for m, g, *_ in taxonomy.MODES if m == mode), 2) for n, mode in taxonomy.MODE_NAMES], *[(f, g, 3) for f, g, _ in taxonomy.FAMILIES]],
    "k", "grp", "step",
)
KEY_SQL = "trim(regexp_replace(upper(trim(value)), '[-_ ]+', '_', 'g'), '_')"


@query(f"""WITH f AS (SELECT family AS value, count(*) AS n FROM ({PARTS}) GROUP BY 1), c AS (SELECT category AS value, count(*) AS n FROM ({PARTS}) WHERE trim(category) <> '' GROUP BY 1),
    g AS (SELECT f.*, (SELECT arg_min(grp, step) FROM {NAMES_SQL} x WHERE x.k = {KEY_SQL.replace("value", "f.value")}) AS grp, coalesce((SELECT label FROM {LABELS_SQL} y WHERE y.k = {KEY_SQL.replace("value", "f.value")}), trim(f.value)) AS label FROM f),
    m AS (SELECT m.grp, m.place, m.value, m.label, m.categories, (SELECT sum(f.n) FROM f WHERE list_contains(m.families, f.value)) AS fn, coalesce((SELECT sum(c.n) FROM c WHERE list_contains(m.categories, c.value)), 0) AS cn,
                 list_filter(m.families, lambda x: list_contains(every, x)) AS present FROM {MODES_SQL} m, (SELECT list(value) AS every FROM f)),
    d AS (SELECT grp, place, value || '|' || label || '|' || CASE WHEN len(categories) > 0 THEN cn ELSE fn END || '|' || array_to_string(present, ',') || '|' || array_to_string(categories, ',') AS said, CASE WHEN len(categories) > 0 THEN cn ELSE fn END AS n FROM m WHERE len(present) > 0 AND NOT (len(categories) > 0 AND cn = 0)
          UNION ALL SELECT grp, -n, value || '|' || label || '|' || n || '|' || value || '|', n FROM g WHERE grp NOT IN ('Frontal', 'Side', 'Rear'))
    SELECT o.value, CAST(o.place AS INTEGER) AS place, CAST(a.n AS BIGINT) AS test_count, a.said AS families, b.said AS details, CAST(b.n AS BIGINT) AS detail_count FROM {GROUPS_SQL} o
    JOIN (SELECT grp, sum(n) AS n, string_agg(value || '|' || label || '|' || n, ';' ORDER BY -n, value) AS said FROM g WHERE grp IS NOT NULL GROUP BY 1) a ON a.grp = o.value
    JOIN (SELECT grp, sum(n) AS n, string_agg(said, ';' ORDER BY place, said) AS said FROM d WHERE grp IS NOT NULL GROUP BY 1) b ON b.grp = o.value""")
def family_options(spark, d):
    p = classified(spark, d)
    counts = lambda c: p.groupBy(F.col(c).alias("value")).agg(F.count(F.lit(1)).alias("test_count"))
    out = taxonomy.options(counts("family"), counts("category"))
    flat = lambda x, *more: F.concat_ws("|", x["value"], x["label"], x["test_count"].cast("string"), *more)
    return out.select(
        "value", "place", "test_count", F.array_join(F.transform("families", lambda x: flat(x)), ";").alias("families"),
        F.array_join(F.transform("details", lambda x: flat(x, F.array_join(x["families"], ","), F.array_join(x["categories"], ","))), ";").alias("details"), "detail_count",
    )


@query(f"""SELECT p_partkey, 'mode' AS said FROM ({PARTS}) WHERE family = 'SIDE_POLE' AND category IN ('SIDE_POLE_NCAP_75DEG_20MPH', 'SIDE_POLE_FMVSS214', 'SIDE_POLE_FMVSS214_MISCoded_VTB')
    UNION ALL SELECT p_partkey, 'open mode' FROM ({PARTS}) WHERE family IN ('FRONTAL_OBLIQUE_RMDB', 'FRONTAL_OBLIQUE_RMDB_EDGE') UNION ALL SELECT p_partkey, 'family' FROM ({PARTS}) WHERE family = 'CHILD_RESTRAINT'""")
def family_selection(spark, d):
    """By another name of a mode, by one of a mode without categories, and by a family."""
    p, of = classified(spark, d), lambda name, said: taxonomy.where_family(classified(spark, d), said, "family", "category").select("p_partkey", F.lit(name).alias("said"))
    return of("mode", "side-pole  ncap").unionByName(of("open mode", "frontal oblique 30deg")).unionByName(of("family", "child restraint")).join(p.select("p_partkey"), "p_partkey", "left_semi")


@query(f"""SELECT p_partkey, 'Rear' AS grp FROM ({PARTS}) WHERE family IN ('REAR_IMPACT', 'REAR_IMPACT_FMVSS301_MODE') UNION ALL SELECT p_partkey, 'Side' FROM ({PARTS}) WHERE family IN ('SIDE_MDB', 'SIDE_POLE', 'side pole', 'SIDE_MDB_NCAP')
    UNION ALL SELECT p_partkey, 'Airbag' FROM ({PARTS}) WHERE family = 'AIRBAG_DEPLOYMENT'""")
def family_group_selection(spark, d):
    p = classified(spark, d)
    of = lambda name, said: taxonomy.where_group(p, said, "family").select("p_partkey", F.lit(name).alias("grp"))
    return of("Rear", "rear-impact").unionByName(of("Side", " SIDE ")).unionByName(of("Airbag", "airbag / occupant protection")).unionByName(of("none", "no such group"))


@query("SELECT p_partkey FROM part WHERE p_type = 'PROMO' AND p_size > 25")
def configuration_and_flag(spark, d):
    p = t(spark, d, "part").select("p_partkey", "p_type", F.array_compact(F.array(F.when(F.col("p_size") > 25, "large"), F.when(F.col("p_size") % 2 == 0, "even"))).alias("flags"))
    return taxonomy.where_configuration(p, "PROMO", "large", "p_type", "flags").select("p_partkey")
