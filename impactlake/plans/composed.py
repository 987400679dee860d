"""A report of fifteen sections over three tables of the star schema, each read once."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators.composed import Section, report, violations
from .queries import query, t

# table, section, key, where, filled, most: the same for Spark and for SQL
SECTIONS = [
    ("lineitem", "rows", None, None, None, None),
    ("lineitem", "duplicate_slots", "concat_ws('|', l_orderkey, l_linenumber)", None, None, 1),
    ("lineitem", "lines_of_order", "l_orderkey", None, None, 7),
    ("lineitem", "returned_by_supplier", "l_suppkey", "l_returnflag = 'R'", "l_linestatus = 'F'", None),
    ("lineitem", "flag_and_status", "concat_ws('|', l_returnflag, l_linestatus)", None, "l_quantity > 25", None),
    ("lineitem", "without_part", "l_partkey", "l_partkey IS NULL", None, 0),
    ("lineitem", "large_discount", "l_linenumber", "l_discount > 0.09", None, 0),
    ("orders", "rows", None, None, None, None),
    ("orders", "orders_of_customer", "o_custkey", None, "o_orderstatus <> 'P'", 30),
    ("orders", "statuses", "o_orderstatus", None, None, None),
    ("orders", "early", "o_orderpriority", "o_orderdate < '1992-02-01'", None, None),
    ("orders", "same_price", "o_totalprice", None, None, 1),
    ("part", "rows", None, None, None, None),
    ("part", "names", "p_name", None, "p_size > 10", 400),
    ("part", "brands_of_promos", "p_brand", "p_type = 'PROMO'", "p_size % 2 = 0", None),
]


def tables(spark, d):
    sql = lambda x: None if x is None else F.expr(x)
    of = lambda name: {s: Section(sql(k), sql(w), sql(f), m) for n, s, k, w, f, m in SECTIONS if n == name}
    return {name: (t(spark, d, name), of(name)) for name in ("lineitem", "orders", "part")}


EACH = " UNION ALL ".join(
    f"""SELECT '{n}' AS table_name, '{s}' AS section, coalesce(CAST({k or "''"} AS VARCHAR), '<NULL>') AS key, count(*) AS n, count(*) FILTER ({f or "true"}) AS filled, {"NULL" if m is None else m}::BIGINT AS most FROM {n} WHERE {w or "true"} GROUP BY 1, 2, 3"""
    for n, s, k, w, f, m in SECTIONS
)
NAMES = "(SELECT * FROM (VALUES " + ", ".join(f"('{n}', '{s}', {'NULL' if m is None else m})" for n, s, _, _, _, m in SECTIONS) + ") AS v(table_name, section, most))"


@query(f"""WITH e AS ({EACH}), r AS (SELECT table_name, section, sum(n) AS row_count, sum(filled) AS filled_count, count(*) AS key_count, count(*) FILTER (n > 1) AS repeated_keys, sum(n - 1) AS surplus_rows, max(n) AS most_rows,
      sum(CASE WHEN most IS NULL THEN 0 WHEN most = 0 THEN n WHEN n > most THEN 1 ELSE 0 END) AS violations FROM e GROUP BY 1, 2)
    SELECT v.table_name, v.section, {", ".join(f"CAST(coalesce({c}, 0) AS BIGINT) AS {c}" for c in ("row_count", "filled_count", "key_count", "repeated_keys", "surplus_rows", "most_rows", "violations"))},
      (SELECT min(key) FROM e WHERE e.table_name = v.table_name AND e.section = v.section AND e.n = r.most_rows) AS commonest_key, CASE WHEN v.most IS NULL THEN 'info' WHEN coalesce(violations, 0) > 0 THEN 'fail' ELSE 'pass' END AS status
    FROM {NAMES} v LEFT JOIN r ON r.table_name = v.table_name AND r.section = v.section""")
def audit_report(spark, d):
    return report(tables(spark, d))


@query(f"""SELECT table_name, section, key, n, CAST(place AS INTEGER) AS place FROM (SELECT *, row_number() OVER (PARTITION BY table_name, section ORDER BY n DESC, key) AS place FROM ({EACH}) WHERE n > most) WHERE place <= 20""")
def audit_violations(spark, d):
    """The worst twenty keys of each failed section: a report for readers."""
    return violations(tables(spark, d), 20)
