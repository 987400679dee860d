"""Which entity a source row belongs to, table by table, as a walk over the rows of a test in order would find it.

A row that names its number belongs to the entity of that number.  A row without one belongs to the entity that at that point of the walk
has equal fallback values (nulls equal nulls), the one made first if there are several; else it makes an entity of its own.  What an entity's values
are at that point depends on the rows it has taken so far.  Still no loop is needed: a row that was found by its fallback values
brings the values the entity has already, so the states of numbered entities follow from their numbered rows alone, as running
values with the stretch of the walk for which they hold; a row without a number looks its values up among those
stretches; and what finds none makes, at the first such place, the one entity that later rows of these values find as well."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import merge


@dataclass(frozen=True)
class Spec:
    """scope: columns that must be equal in any case; number: the column that names an entity (None: there is none); fallback: columns that tell
    entities without a number apart; alone: rows without any fallback value belong to the first entity without a number, in scopes equal to this value
    of the first scope column; elsewhere such rows are entities of their own."""

    fallback: tuple[str, ...]
    number: str | None = None
    scope: tuple[str, ...] = ()
    alone: str | None = None

    @property
    def columns(self) -> tuple[str, ...]:
        return (*self.scope, *([self.number] if self.number else []), *self.fallback)


# fixed values: what tells the entities of each canonical table apart within a test
SPECS = {
    "vehicles": Spec(("make", "model", "model_year"), "vehicle_no"),
    "barriers": Spec(("rigidity", "shape", "angle_raw")),
    "participants": Spec(("name",), "vehicle_no", ("kind",), "barrier"),
    "occupants": Spec(("vehicle_no", "seat")),
    "restraints": Spec(("subject_kind", "vehicle_no", "seat", "restraint_type", "deployment")),
    "channels": Spec(("curve_no",)),
    "assets": Spec(("kind", "url")),
}


def with_parts(rows: DataFrame, table: str) -> DataFrame:
    """The columns a spec needs that are made of others: the seat in its normal form, else as it is written; what a restraint belongs to."""
    if table not in ("occupants", "restraints"):
        return rows
    out = rows.withColumn("seat", F.coalesce("location", "location_raw"))
    known = F.when(F.col("location_raw") != "UNKNOWN", F.col("location_raw"))
    return out if table == "occupants" else out.withColumn("subject_kind", merge.restraint_identity(F.col("vehicle_no"), known))


def _digest(kind: str, columns: list[Column | str]) -> Column:
    cells = [F.coalesce(F.concat(F.lit("="), (F.col(c) if isinstance(c, str) else c).cast("string")), F.lit("-")) for c in columns]
    return F.sha2(F.to_json(F.array(F.lit(kind), *cells)), 256)


def resolve(rows: DataFrame, spec: Spec, order: list[str], priority: Column | str, test: str = "test_no") -> DataFrame:
    """Adds entity_key; order: columns that put the rows of a test in a total order."""
    group = [test, *spec.scope]
    own = _digest("fallback", list(spec.fallback))
    if spec.number is None:
        return rows.withColumn("entity_key", own)
    base = rows.withColumn("_at", F.struct(*order)).withColumn("_priority", priority if isinstance(priority, Column) else F.col(priority))
    has, same = F.col(spec.number).isNotNull(), [test, *spec.scope, *spec.fallback]
    numbered = base.where(has).withColumn("entity_key", _digest("number", [*spec.scope, spec.number]))

    # the values of numbered entities, and from where to where they hold
    along = Window.partitionBy(*group, spec.number).orderBy("_at")
    so_far = along.rowsBetween(Window.unboundedPreceding, 0)
    begun = numbered.withColumn("_p1", F.first("_priority").over(so_far)).withColumn("_made", F.first("_at").over(so_far))
    renamed = begun.withColumn("priority", F.col("_priority"))
    states = renamed.select(*group, "entity_key", "_made", F.col("_at").alias("_from"), F.lead("_at").over(along).alias("_to"), *[merge._value(c, so_far, "priority").alias(c) for c in spec.fallback])

    # rows without a number: the first entity that has their values just then
    empty = F.lit(True)
    for c in spec.fallback:
        empty = empty & F.col(c).isNull()
    single = spec.alone is not None
    open_ = base.where(~has & ~empty) if single else base.where(~has)
    on = [F.col(f"o.{c}").eqNullSafe(F.col(f"s.{c}")) for c in same] + [F.col("o._at") > F.col("s._from"), F.col("s._to").isNull() | (F.col("o._at") < F.col("s._to"))]
    hits = open_.select(*same, "_at").alias("o").join(states.alias("s"), on).groupBy(*[F.col(f"o.{c}").alias(c) for c in (test, "_at")]).agg(F.min_by("s.entity_key", "s._made").alias("_hit"), F.min("s._made").alias("_made"))
    looked = open_.alias("o").join(hits.alias("h"), [F.col(f"o.{test}").eqNullSafe(F.col(f"h.{test}")), F.col("o._at") == F.col("h._at")], "left").select("o.*", "h._hit", "h._made")
    # the first row of these values that finds none makes an entity, which later ones find too
    firsts = looked.where("_hit is null").groupBy(*same).agg(F.min("_at").alias("_first"))
    both = looked.alias("o").join(firsts.alias("f"), [F.col(f"o.{c}").eqNullSafe(F.col(f"f.{c}")) for c in same], "left").select("o.*", "f._first")
    older = F.col("_first").isNull() | (F.col("_at") < F.col("_first")) | (F.col("_made") < F.col("_first"))
    new = _digest("fallback", [*spec.scope, *spec.fallback])
    placed = both.withColumn("entity_key", F.when(F.col("_hit").isNotNull() & older, F.col("_hit")).otherwise(new))
    parts = [numbered.drop("_at", "_priority"), placed.select(*rows.columns, "entity_key")]

    if single:  # rows without number and values
        bare = base.where(~has & empty)
        lone = F.col(spec.scope[0]) == spec.alone
        makers = firsts.select(*group, F.col("_first").alias("_at"), new.alias("_key")).unionByName(bare.select(*group, "_at", new.alias("_key")))
        first = makers.where(lone).groupBy(*group).agg(F.min_by("_key", "_at").alias("_key"))
        found = bare.alias("o").join(first.alias("f"), [F.col(f"o.{c}").eqNullSafe(F.col(f"f.{c}")) for c in group], "left").select("o.*", "f._key")
        parts.append(found.withColumn("entity_key", F.coalesce("_key", _digest("row", [F.to_json("_at")]))).select(*rows.columns, "entity_key"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def place(json_path: Column) -> Column:
    """The numbers of a path as an array, so that row 10 comes after row 2."""
    return F.transform(F.regexp_extract_all(json_path, F.lit(r"\[(\d+)\]"), F.lit(1)), lambda x: x.cast("int"))


def merged(rows: DataFrame, spec: Spec, priority: Column, lineage: tuple[str, ...] = ("payload_id", "endpoint_name", "section", "json_path", "row_hash")) -> DataFrame:
    """One row an entity, its values folded by priority in the order of payloads and of their rows; entity_key and source_rows are added."""
    ranked = rows.withColumn("_rank", priority).withColumn("_place", place(F.col("json_path")))
    order, values = ["payload_id", "_place", "section"], [c for c in rows.columns if c not in ("test_no", *lineage)]
    return merge.fold(resolve(ranked, spec, order, "_rank"), ["test_no", "entity_key"], values, order, "_rank")
