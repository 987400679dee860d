"""Crash families in groups, with labels, other names and detail modes: filters by them, and facet counts put under them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# fixed values: groups in the order in which they are shown
GROUPS = ["Frontal", "Side", "Rear", "Rollover", "ADAS", "PED", "EJM", "Child Restraint", "Airbag / Occupant Protection", "Interior Fitting", "Sled / Research", "Bumper / Damageability"]
# fixed values: family, its group, its label (None: the family itself)
FAMILIES = [
    ("FRONTAL_FIXED_BARRIER", "Frontal", "정면 고정벽 family"),
    ("FRONTAL_OBLIQUE_RMDB", "Frontal", "OBLIQUE/RMDB"),
    ("FRONTAL_OBLIQUE_RMDB_EDGE", "Frontal", "OBLIQUE/RMDB edge"),
    ("FRONTAL_OFFSET", "Frontal", "VTV 옵셋 연구"),
    ("SIDE_MDB", "Side", "측면 MDB family"),
    ("SIDE_POLE", "Side", "측면 Pole family"),
    ("REAR_IMPACT", "Rear", "후방 충돌 family"),
    ("ROLLOVER", "Rollover", None),
    ("ADAS_FCW", "ADAS", None),
    ("ADAS_LDW", "ADAS", None),
    ("ADAS_TJA", "ADAS", None),
    ("PEDESTRIAN", "PED", None),
    ("EJM", "EJM", None),
    ("CHILD_RESTRAINT", "Child Restraint", None),
    ("AIRBAG_DEPLOYMENT", "Airbag / Occupant Protection", None),
    ("INTERIOR_FITTING_OR_SEAT_RESEARCH", "Interior Fitting", None),
    ("SLED_RESEARCH", "Sled / Research", None),
    ("BUMPER_DAMAGEABILITY", "Bumper / Damageability", None),
]
# fixed values: detail mode, its group, its label, families and categories (none: all of the families)
MODES = [
    ("FRONTAL_FIXED_WALL_MODE", "Frontal", "정면 고정벽", ["FRONTAL_FIXED_BARRIER"], ["FMVSS208_56K_FIXED_WALL", "FRONTAL_FIXED_BARRIER_NCAP_35MPH", "FRONTAL_FIXED_BARRIER_RESEARCH_OR_OTHER"]),
    ("FRONTAL_FIXED_WALL_UNBELTED_MODE", "Frontal", "정면 고정벽_unbelted", ["FRONTAL_FIXED_BARRIER"], ["FMVSS208_40K_UNBELTED_FIXED_WALL"]),
    ("FRONTAL_40PCT_OFFSET_ODB_MODE", "Frontal", "40% 옵셋(ODB)", ["FRONTAL_FIXED_BARRIER"], ["FMVSS208_40PCT_OFFSET_ODB"]),
    ("FRONTAL_30DEG_ANGLED_FIXED_WALL_UNBELTED_MODE", "Frontal", "30도 경사_unbelted", ["FRONTAL_FIXED_BARRIER"], ["FMVSS208_30DEG_ANGLED_FIXED_WALL"]),
    ("FRONTAL_OBLIQUE_RMDB_MODE", "Frontal", "OBLIQUE/RMDB", ["FRONTAL_OBLIQUE_RMDB", "FRONTAL_OBLIQUE_RMDB_EDGE"], []),
    ("FRONTAL_OFFSET_VTV_RESEARCH_MODE", "Frontal", "VTV 옵셋 연구", ["FRONTAL_OFFSET"], ["FRONTAL_OFFSET_VTV_15DEG_50PCT_RESEARCH_NON_FMVSS208"]),
    ("SIDE_MDB_NCAP_38_5MPH_MODE", "Side", "MDB_NCAP", ["SIDE_MDB"], ["SIDE_MDB_NCAP_38_5MPH"]),
    ("SIDE_MDB_FMVSS214_MODE", "Side", "MDB_FMVSS214", ["SIDE_MDB"], ["SIDE_MDB_FMVSS214"]),
    ("SIDE_MDB_RESEARCH_OR_OTHER_MODE", "Side", "MDB_research", ["SIDE_MDB"], ["SIDE_MDB_RESEARCH_OR_OTHER"]),
    ("SIDE_POLE_MODE", "Side", "POLE", ["SIDE_POLE"], ["SIDE_POLE_NCAP_75DEG_20MPH", "SIDE_POLE_FMVSS214", "SIDE_POLE_FMVSS214_MISCoded_VTB"]),
    ("SIDE_POLE_RESEARCH_OR_OTHER_MODE", "Side", "POLE_research", ["SIDE_POLE"], ["SIDE_POLE_RESEARCH_OR_OTHER"]),
    ("REAR_IMPACT_FMVSS301_MODE", "Rear", "후방 FMVSS301", ["REAR_IMPACT"], ["REAR_IMPACT_FMVSS301"]),
    ("REAR_IMPACT_RESEARCH_VTV_OR_ITV_MODE", "Rear", "후방 Research/VTV/ITV", ["REAR_IMPACT"], ["REAR_IMPACT_RESEARCH_VTV_OR_ITV"]),
]
# fixed values: other names of detail modes
MODE_NAMES = [
    ("FMVSS208_FIXED_WALL", "FRONTAL_FIXED_WALL_MODE"),
    ("FMVSS208_40K_UNBELTED_FIXED_WALL", "FRONTAL_FIXED_WALL_UNBELTED_MODE"),
    ("FRONTAL_FIXED_WALL_UNBELTED", "FRONTAL_FIXED_WALL_UNBELTED_MODE"),
    ("FMVSS208_40PCT_OFFSET_ODB", "FRONTAL_40PCT_OFFSET_ODB_MODE"),
    ("FMVSS208_30DEG_ANGLED_FIXED_WALL", "FRONTAL_30DEG_ANGLED_FIXED_WALL_UNBELTED_MODE"),
    ("FRONTAL_30DEG_ANGLED_FIXED_WALL_MODE", "FRONTAL_30DEG_ANGLED_FIXED_WALL_UNBELTED_MODE"),
    ("FRONTAL_30DEG_ANGLED_FIXED_WALL_UNBELTED", "FRONTAL_30DEG_ANGLED_FIXED_WALL_UNBELTED_MODE"),
    ("FRONTAL_OBLIQUE_30DEG", "FRONTAL_OBLIQUE_RMDB_MODE"),
    ("SIDE_MDB_NCAP", "SIDE_MDB_NCAP_38_5MPH_MODE"),
    ("SIDE_MDB_NCAP_38_5MPH", "SIDE_MDB_NCAP_38_5MPH_MODE"),
    ("SIDE_MDB_FMVSS214", "SIDE_MDB_FMVSS214_MODE"),
    ("SIDE_MDB_RESEARCH_OR_OTHER", "SIDE_MDB_RESEARCH_OR_OTHER_MODE"),
    ("SIDE_MDB_RESEARCH", "SIDE_MDB_RESEARCH_OR_OTHER_MODE"),
    ("SIDE_POLE_NCAP", "SIDE_POLE_MODE"),
    ("SIDE_POLE_NCAP_75DEG_20MPH", "SIDE_POLE_MODE"),
    ("SIDE_POLE_NCAP_75DEG_20MPH_MODE", "SIDE_POLE_MODE"),
    ("SIDE_POLE_FMVSS214", "SIDE_POLE_MODE"),
    ("SIDE_POLE_FMVSS214_MODE", "SIDE_POLE_MODE"),
    ("SIDE_POLE_RESEARCH_OR_OTHER", "SIDE_POLE_RESEARCH_OR_OTHER_MODE"),
    ("SIDE_POLE_RESEARCH", "SIDE_POLE_RESEARCH_OR_OTHER_MODE"),
    ("REAR_IMPACT_FMVSS301", "REAR_IMPACT_FMVSS301_MODE"),
    ("REAR_IMPACT_RESEARCH_VTV_OR_ITV", "REAR_IMPACT_RESEARCH_VTV_OR_ITV_MODE"),
]
# fixed values: names of families that go straight to a group, before all others
OLD_NAMES = [("FRONTAL", "Frontal"), ("FRONT", "Frontal"), ("FRONTAL_BARRIER", "Frontal"), ("SIDE", "Side"), ("SIDE_POLE", "Side"), ("SIDEPOLE", "Side"), ("POLE", "Side")]
# fixed values: how users write groups besides their own names
GROUP_NAMES = [
    ("front", "Frontal"), ("frontal", "Frontal"), ("side", "Side"), ("rear", "Rear"), ("rear_impact", "Rear"), ("rollover", "Rollover"), ("adas", "ADAS"), ("ped", "PED"), ("pedestrian", "PED"), ("ejm", "EJM"), ("ejection_mitigation", "EJM"),
    ("child", "Child Restraint"), ("child_restraint", "Child Restraint"), ("airbag", "Airbag / Occupant Protection"), ("airbag_deployment", "Airbag / Occupant Protection"), ("occupant_protection", "Airbag / Occupant Protection"),
    ("interior", "Interior Fitting"), ("interior_fitting", "Interior Fitting"), ("sled", "Sled / Research"), ("sled_research", "Sled / Research"), ("bumper", "Bumper / Damageability"), ("bumper_damageability", "Bumper / Damageability"),
]

#: What a name in its key form is a name of, by the first list that has it.
GROUP_OF = dict([*((f, g) for f, g, _ in FAMILIES), *((name, g) for name, mode in MODE_NAMES for m, g, *_ in MODES if m == mode), *((m, g) for m, g, *_ in MODES), *OLD_NAMES])
LABEL_OF = {**{f: label for f, _, label in FAMILIES if label}, **{m: label for m, _, label, *_ in MODES}}
MODE_OF = {**dict(MODE_NAMES), **{m: m for m, *_ in MODES}}


def _joined(value: str, cut: str) -> str:
    for c in cut:
        value = value.replace(c, "_")
    return "_".join(p for p in value.split("_") if p)


def key(value: Column) -> Column:
    """The key form of a family: upper case, blanks and dashes as single underscores, none at the ends."""
    return F.trim(F.regexp_replace(F.upper(F.trim(F.coalesce(value, F.lit("")))), "[-_ ]+", "_"), F.lit("_"))


def _looked_up(value: Column, table: dict[str, str], default: Column) -> Column:
    return F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for pair in table.items() for x in pair]), value), default)


def group(family: Column) -> Column:
    """The group of a family, a detail mode or another name of them; null for none."""
    return _looked_up(key(family), GROUP_OF, F.lit(None).cast("string"))


def label(family: Column) -> Column:
    """The label of a family or mode, else the trimmed value."""
    return _looked_up(key(family), LABEL_OF, F.trim(F.coalesce(family, F.lit(""))))


def group_named(said: str | None) -> str | None:
    """The group that a user means, however it is written; None for none."""
    name = _joined((said or "").strip().lower(), "-/ ")
    return dict([*((_joined(g.lower(), "/ "), g) for g in GROUPS), *GROUP_NAMES]).get(name)


def selection(said: str) -> tuple[list[str], list[str]]:
    """Families and categories (none: all) that a family, a mode or another name of one selects."""
    name = _joined(said.strip().upper(), "- ")
    mode = MODE_OF.get(name)
    return next(((families, categories) for m, _, _, families, categories in MODES if m == mode), ([name], []))


def where_family(df: DataFrame, said: str | None, family: str = "test_family", category: str = "official_category") -> DataFrame:
    """Rows of the selected families, and of the mode's categories where it has some; an empty selection does not filter."""
    if not said:
        return df
    families, categories = selection(said)
    out = df.where(F.col(family).isin(families))
    return out.where(F.col(category).isin(categories)) if categories else out


def where_group(df: DataFrame, said: str | None, family: str = "test_family") -> DataFrame:
    """Rows whose family is of the group; of an unknown group there are none."""
    if not said:
        return df
    named = group_named(said)
    return df.where(group(F.col(family)) == named) if named else df.where(F.lit(False))


def where_configuration(df: DataFrame, configuration_key: str | None = None, flag: str | None = None, configuration: str = "test_configuration_key", flags: str = "metadata_flags") -> DataFrame:
    """Rows of a configuration key, and those that bear a flag (`flags`: an array)."""
    out = df.where(F.col(configuration) == configuration_key) if configuration_key else df
    return out.where(F.coalesce(F.array_contains(flags, flag), F.lit(False))) if flag else out


def options(families: DataFrame, categories: DataFrame) -> DataFrame:
    """Facet counts by group: value, place, test_count, families (value, label, test_count) and details (value, label, test_count, families, categories), in the taxonomy's order.

    families, categories: value and test_count.  A group that has detail modes shows those of its families that occur; a mode with categories counts them, and
    is left out where categories are counted at all but none of its own is.  detail_count is the sum of what the details count."""
    spark: SparkSession = families.sparkSession
    places = {g: i for i, g in enumerate(GROUPS)}
    modes = spark.createDataFrame([(m, g, i, says, f, c) for i, (m, g, says, f, c) in enumerate(MODES)], "value string, group string, place int, label string, families array<string>, categories array<string>")
    own = families.select("value", "test_count", group(F.col("value")).alias("group"), label(F.col("value")).alias("label")).where("group is not null")
    one = F.struct((-F.col("test_count")).alias("by"), "value", "label", "test_count")
    shown = lambda c: F.transform(F.array_sort(F.collect_list(c)), lambda x: F.struct(x["value"], x["label"], x["test_count"]))
    by_group = own.groupBy("group").agg(F.sum("test_count").alias("test_count"), shown(one).alias("families"))

    # modes: what their families and their categories count; both sides of these joins are no larger than the taxonomy
    there = modes.select("value", F.posexplode("families").alias("at", "family")).join(families.select(F.col("value").alias("family"), F.col("test_count").alias("n")), "family")
    there = there.groupBy("value").agg(F.sum("n").alias("family_count"), F.transform(F.array_sort(F.collect_list(F.struct("at", "family"))), lambda x: x["family"]).alias("present"))
    counted = categories.where("trim(value) != ''")
    of_mode = modes.select("value", F.explode("categories").alias("category")).join(counted.select(F.col("value").alias("category"), F.col("test_count").alias("n")), "category").groupBy("value").agg(F.sum("n").alias("category_count"))
    any_ = counted.agg((F.count(F.lit(1)) > 0).alias("any"))
    listed = modes.join(there, "value").join(of_mode, "value", "left").crossJoin(F.broadcast(any_))  # the right side is one row
    total, has = F.coalesce("category_count", F.lit(0)), F.size("categories") > 0
    listed = listed.where(~(has & F.col("any") & (total == 0))).withColumn("n", F.when(has, total).otherwise(F.col("family_count")))
    detail = F.struct("place", "value", "label", F.col("n").alias("test_count"), F.col("present").alias("families"), "categories")
    details = listed.groupBy("group").agg(F.transform(F.array_sort(F.collect_list(detail)), lambda x: F.struct(x["value"], x["label"], x["test_count"], x["families"], x["categories"])).alias("details"))
    plain = F.transform("families", lambda x: F.struct(x["value"], x["label"], x["test_count"], F.array(x["value"]).alias("families"), F.array().cast("array<string>").alias("categories")))
    with_modes = F.col("group").isin(sorted({g for _, g, *_ in MODES}))
    out = by_group.join(details, "group", "left").withColumn("details", F.when(with_modes, F.coalesce("details", F.array().cast(details.schema["details"].dataType))).otherwise(plain))
    count = F.aggregate("details", F.lit(0).cast("long"), lambda a, x: a + x["test_count"])
    return out.select(F.col("group").alias("value"), _place(F.col("group"), places).alias("place"), "test_count", "families", "details", count.alias("detail_count"))


def _place(group_: Column, places: dict[str, int]) -> Column:
    return F.try_element_at(F.create_map(*[F.lit(x) for pair in places.items() for x in pair]), group_)
