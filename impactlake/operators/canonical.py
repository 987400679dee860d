"""Typed tables out of exploded rows: one spec a table, first present key wins."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import dates, numbers, presence, text

LINEAGE = ["payload_id", "endpoint_name", "section", "json_path", "row_hash"]


@dataclass(frozen=True)
class Field:
    """A column: the keys it is read from, in order, and how (string, int, number or date; raw is kept beside the last two)."""

    name: str
    keys: tuple[str, ...]
    kind: str = "string"


# fixed values: keys of the source rows
TESTS = [
    Field("reference_no", ("testReferenceNo",)), Field("test_type", ("testType",)), Field("test_date", ("testDate", "TSTDAT"), "date"), Field("performer", ("testPerformer", "TSTPRFD")),
    Field("title", ("contractorStudyTitle",)), Field("configuration", ("testConfiguration", "TSTCFND")), Field("configuration_key", ("testConfigurationKey",)),
    Field("impact_angle", ("impactAngle",), "number"), Field("offset_distance", ("offsetDistance",), "number"), Field("closing_speed", ("closingSpeed", "CLSSPD"), "number"),
]
VEHICLES = [
    Field("vehicle_no", ("vehicleNo", "VEHNO"), "int"), Field("make", ("vehicleMake", "MAKED")), Field("model", ("vehicleModel", "MODELD")), Field("model_year", ("modelYear", "YEAR"), "int"),
    Field("engine_type", ("engineType",)), Field("speed", ("vehicleSpeed", "VEHSPD"), "number"), Field("weight", ("vehicleTestWeight", "VEHTWT"), "number"),
]
BARRIERS = [Field("rigidity", ("rigidOrDeformableBarrier", "BARRIGD")), Field("shape", ("barrierShape", "BARSHPD")), Field("angle", ("angleofFixedBarrier", "BARANG"), "number")]
OCCUPANTS = [Field("vehicle_no", ("vehicleNo", "VEHNO"), "int"), Field("location_raw", ("occupantLocation", "OCCLOC")), Field("occupant_type", ("occupantType", "OCCTYPD")), Field("dummy_type", ("dummyType",))]
RESTRAINTS = [
    Field("vehicle_no", ("vehicleNo", "VEHNO"), "int"), Field("location_raw", ("occupantLocation", "OCCLOC", "OCCLOCD")), Field("restraint_type", ("restraintType", "RSTTYPD")),
    Field("deployment", ("inflationer", "BeltPretensionerDeployment", "inflationer/BeltPretensionerDeployment", "deploymentStatus", "DEPLOYD")),
]
CHANNELS = [
    Field("curve_no", ("curveNo", "CURNO"), "int"), Field("sensor_type", ("sensorType", "SENTYPD")), Field("sensor_location", ("sensorLocation",)), Field("sensor_attachment", ("sensorAttachment",)),
    Field("axis", ("axisDirofSensor",)), Field("unit", ("unit", "dataMeasurementUnits")), Field("first_point", ("firstPoint", "numberofFirstPoint"), "int"), Field("last_point", ("lastPoint", "numberofLastPoint"), "int"),
    Field("time_increment", ("timeIncrement",), "number"), Field("channel_status", ("channelStatus",)), Field("data_status", ("dataStatus",)),
]
INTRUSIONS = [Field("vehicle_no", ("vehicleNo", "VEHNO"), "int"), Field("measurement_code", ("measurementCode",)), Field("intrusion", ("intrusion",), "number"), Field("unit", ("unit",))]
# fixed values: codes of injury metrics and of deformation measurements
INJURY_CODES = ["HIC", "CSI", "TTI", "LFEM", "RFEM", "LBELT", "SBELT"]
DEFORMATION_CODES = ["DPD1", "DPD2", "DPD3", "DPD4", "DPD5", "DPD6", "DAMDST", "CRHDST", "PDOF", "VDI"]
IMPACTOR_MAKE = "NHTSA"  # fixed value: the make that impactors are listed under
PACKAGE_KEYS = {"udsFiles": "UDS", "evFiles": "EV", "abfFiles": "ABF", "isoFiles": "ISO", "tdmsFiles": "TDMS"}
SECTIONS = {
    "tests": ["test_summary", "test_detail", "TEST"], "vehicles": ["vehicle_info", "vehicle_detail", "VEHICLE"], "barriers": ["barrier_info", "BARRIER"], "occupants": ["occupant_info", "occupant_detail", "OCCUPANT"],
    "restraints": ["restraint_info", "RESTRAINT"], "channels": ["instrumentation_info", "instrumentation_detail", "INSTRUMENTATION"], "intrusions": ["intrusion_info"], "assets": ["multimedia_files", "vehicle_documents", "URL", "REPORTS", "VIDEOS", "PHOTOS"],
}
# fixed values: seats as sources write them, and their normal form
LOCATIONS = {
    "01": "LEFT_FRONT",
    "1": "LEFT_FRONT",
    "DRIVER": "LEFT_FRONT",
    "LEFT FRONT": "LEFT_FRONT",
    "LEFT FRONT SEAT": "LEFT_FRONT",
    "FRONT LEFT": "LEFT_FRONT",
    "FRONT LEFT SEAT": "LEFT_FRONT",
    "02": "RIGHT_FRONT",
    "2": "RIGHT_FRONT",
    "PASSENGER": "RIGHT_FRONT",
    "RIGHT FRONT": "RIGHT_FRONT",
    "RIGHT FRONT SEAT": "RIGHT_FRONT",
    "FRONT RIGHT": "RIGHT_FRONT",
    "FRONT RIGHT SEAT": "RIGHT_FRONT",
    "03": "RIGHT_REAR",
    "3": "RIGHT_REAR",
    "RIGHT REAR": "RIGHT_REAR",
    "RIGHT REAR SEAT": "RIGHT_REAR",
    "REAR RIGHT": "RIGHT_REAR",
    "REAR RIGHT SEAT": "RIGHT_REAR",
    "04": "LEFT_REAR",
    "4": "LEFT_REAR",
    "LEFT REAR": "LEFT_REAR",
    "LEFT REAR SEAT": "LEFT_REAR",
    "REAR LEFT": "LEFT_REAR",
    "REAR LEFT SEAT": "LEFT_REAR",
    "REAR PASSENGER": "LEFT_REAR",
}


def columns(spec: list[Field], raws: dict[str, Column]) -> list[Column]:
    """The typed columns of a spec; raws: what the source says, by field."""
    out = []
    for f in spec:
        raw = raws[f.name]
        if f.kind == "number":
            out += [raw.alias(f"{f.name}_raw"), numbers.number_value(raw).alias(f.name), numbers.number_status(raw).alias(f"{f.name}_status")]
        elif f.kind == "date":
            out += [raw.alias(f"{f.name}_raw"), dates.date_value(raw).alias(f.name), dates.date_status(raw).alias(f"{f.name}_status")]
        else:
            out.append((raw.try_cast("int") if f.kind == "int" else raw).alias(f.name))
    return out


def location(raw: Column) -> Column:
    """The normal form of a seat; unknown is null."""
    n = text.normalize_text(raw)
    known = F.create_map(*[F.lit(x) for pair in LOCATIONS.items() for x in pair])
    return F.when(n.isNull() | (n == "UNKNOWN"), None).otherwise(F.coalesce(F.try_element_at(known, n), F.replace(n, F.lit(" "), F.lit("_"))))


def _rows(rows: DataFrame, table: str) -> DataFrame:
    return rows.where(F.col("section").isin(SECTIONS[table]))


def project(rows: DataFrame, table: str, spec: list[Field]) -> DataFrame:
    """A canonical table of exploded rows (test_no, lineage, data)."""
    lineage = [c for c in LINEAGE if c in rows.columns]
    # a projection of its own, so that each value is taken out of its object once, however many columns come of it
    found = _rows(rows, table).select("test_no", *[presence.first_present(F.col("data"), f.keys).alias(f"_{f.name}") for f in spec], *lineage)
    return found.select("test_no", *columns(spec, {f.name: F.col(f"_{f.name}") for f in spec}), *lineage)


def tests(rows: DataFrame, order: list[str] | None = None) -> DataFrame:
    """One row a test: the first of its source rows."""
    all_ = project(rows, "tests", TESTS)
    first = Window.partitionBy("test_no").orderBy(*(order or ["payload_id", "json_path"]))
    return all_.withColumn("_n", F.row_number().over(first)).where("_n = 1").drop("_n")


def participants(vehicles: DataFrame, barriers: DataFrame, impactor_make: str | None = IMPACTOR_MAKE) -> DataFrame:
    """Vehicles (subjects and impactors) and barriers that take part in a test, with the lineage that both tables have."""
    lineage = [c for c in LINEAGE if c in vehicles.columns and c in barriers.columns]
    v = vehicles.select("test_no", F.col("vehicle_no"), participant_kind(F.col("make"), F.col("model"), impactor_make).alias("kind"), F.concat_ws(" ", "make", "model").alias("name"), *lineage)
    b = barriers.select("test_no", F.lit(None).cast("int").alias("vehicle_no"), F.lit("barrier").alias("kind"), F.concat_ws(" ", "rigidity", "shape").alias("name"), *lineage)
    return v.unionByName(b)


def participant_kind(make: Column, model: Column, impactor_make: str | None = IMPACTOR_MAKE) -> Column:
    """Impactors by their model, of that make only (None: of any)."""
    hit = F.coalesce(F.upper(model).contains("IMPACTOR"), F.lit(False))
    if impactor_make:
        hit = hit & (F.upper(F.coalesce(make, F.lit(""))) == impactor_make.upper())
    return F.when(hit, "impactor_vehicle").otherwise("subject_vehicle")


def present_codes(rows: DataFrame, codes: list[str], keep: list[Column], data: str = "data") -> DataFrame:
    """Unpivot: a row for each code whose key is there, null values included."""
    # each code is looked up once, and only what is there is read
    found = rows.select(*keep, *[F.try_variant_get(data, presence._path(c), "variant").alias(f"_c{i}") for i, c in enumerate(codes)])
    cells = [F.when(F.col(f"_c{i}").isNotNull(), F.struct(F.lit(c).alias("code"), F.try_variant_get(f"_c{i}", "$", "string").alias("raw"))) for i, c in enumerate(codes)]
    each = found.select(*found.columns[: len(keep)], F.explode(F.array_compact(F.array(*cells))).alias("c"))
    raw = F.col("c.raw")
    return each.select(*[c for c in each.columns if c != "c"], F.col("c.code").alias("code"), raw.alias("raw"), numbers.number_value(raw).alias("value"), numbers.number_status(raw).alias("status"))


def injuries(rows: DataFrame) -> DataFrame:
    loc = F.coalesce(presence.first_present(F.col("data"), ("occupantLocation", "OCCLOC")), F.lit("UNKNOWN"))
    return present_codes(_rows(rows, "occupants"), INJURY_CODES, [F.col("test_no"), presence.first_present(F.col("data"), ("vehicleNo", "VEHNO"), "int").alias("vehicle_no"), loc.alias("location_raw")])


def deformations(rows: DataFrame) -> DataFrame:
    return present_codes(_rows(rows, "vehicles"), DEFORMATION_CODES, [F.col("test_no"), presence.first_present(F.col("data"), ("vehicleNo", "VEHNO"), "int").alias("vehicle_no")])


def assets(rows: DataFrame) -> DataFrame:
    """A row for each URL: of the row itself, else of each package column that holds one."""
    own = presence.first_present(F.col("data"), ("url", "URL"))
    kind = presence.first_present(F.col("data"), ("documentType", "type", "title"))
    packs = F.array(*[F.struct(presence.get(F.col("data"), k).alias("url"), F.lit(v).alias("document_type")) for k, v in PACKAGE_KEYS.items()])
    urls = F.when(F.coalesce(own, F.lit("")) != "", F.array(F.struct(own.alias("url"), kind.alias("document_type")))).otherwise(F.filter(packs, lambda x: F.coalesce(x["url"], F.lit("")) != ""))
    each = _rows(rows, "assets").select("test_no", *[c for c in LINEAGE if c in rows.columns], F.explode(urls).alias("a"))
    url, doc = F.col("a.url"), F.col("a.document_type")
    return each.select("test_no", *[c for c in LINEAGE if c in rows.columns], url.alias("url"), doc.alias("document_type"), text.filename(url).alias("filename"), text.extension(url).alias("extension"), asset_kind(url, doc).alias("kind"), asset_subtype(url, doc).alias("subtype"))


# rule lists: (result, tokens); the first that is contained wins
SUBTYPES = [("TDMS", ["tdms"]), ("UDS", ["uds"]), ("EV", [".ev", " ev", "/ev/"]), ("ABF", ["abf"]), ("ISO", ["iso"]), ("ZIP", [".zip"]), ("PDF", [".pdf"]), ("HTML", [".htm"])]
KINDS = [("photo", [".jpg", ".jpeg", ".png"]), ("video", [".mp4", ".mov", ".wmv", ".avi"]), ("report", [".pdf"])]
PACKAGES = ["UDS", "EV", "ABF", "ISO", "TDMS", "ZIP"]


def cascade(text_: Column, rules: list[tuple[str, list[str]]], default: Column | str | None) -> Column:
    """CASE by contained tokens."""
    out = F
    for result, tokens in rules:
        hit = F.lit(False)
        for t in tokens:
            hit = hit | text_.contains(t)
        out = out.when(hit, result)
    return out.otherwise(default)


def cascade_sql(text_: str, rules: list[tuple[str, list[str]]], default: str) -> str:
    """The same CASE as SQL."""
    whens = " ".join(f"WHEN {' OR '.join(f'contains({text_}, {chr(39)}{t}{chr(39)})' for t in tokens)} THEN '{result}'" for result, tokens in rules)
    return f"CASE {whens} ELSE {default} END"


def asset_text(url: Column, document_type: Column) -> Column:
    return F.lower(F.concat_ws(" ", F.coalesce(url, F.lit("")), F.coalesce(document_type, F.lit(""))))


def asset_subtype(url: Column, document_type: Column) -> Column:
    return cascade(asset_text(url, document_type), SUBTYPES, "UNKNOWN")


def asset_kind(url: Column, document_type: Column) -> Column:
    t = asset_text(url, document_type)
    return cascade(t, KINDS, F.when(asset_subtype(url, document_type).isin(PACKAGES), "data_package").when(t.contains("document"), "document").otherwise("other"))


def scope_decisions(tests_: DataFrame, least: str = "2011-01-01") -> DataFrame:
    """Per test: the least parsed date of all its source rows decides."""
    by = tests_.groupBy("test_no").agg(F.min(F.when(F.col("test_date_status") == "parsed", F.col("test_date"))).alias("date"), F.bool_or(F.col("test_date_status").isin("invalid", "partial")).alias("bad"))
    status = F.when(F.col("date") >= F.lit(least).cast("date"), "in_scope").when(F.col("date").isNotNull(), "out_of_scope").when(F.col("bad"), "date_parse_failed").otherwise("missing_test_date")
    return by.select("test_no", "date", status.alias("status"))


def tables(rows: DataFrame) -> dict[str, DataFrame]:
    """All canonical tables of exploded rows."""
    v, b = project(rows, "vehicles", VEHICLES), project(rows, "barriers", BARRIERS)
    located = lambda d: d.withColumn("location_raw", F.coalesce("location_raw", F.lit("UNKNOWN"))).withColumn("location", location(F.col("location_raw")))
    return {
        "tests": tests(rows),
        "vehicles": v,
        "barriers": b,
        "participants": participants(v, b),
        "occupants": located(project(rows, "occupants", OCCUPANTS)),
        "restraints": located(project(rows, "restraints", RESTRAINTS)),
        "channels": project(rows, "channels", CHANNELS),
        "intrusions": project(rows, "intrusions", INTRUSIONS).withColumn("measurement_code", F.coalesce(F.nullif("measurement_code", F.lit("")), F.lit("unknown"))),
        "assets": assets(rows),
        "injuries": injuries(rows),
        "deformations": deformations(rows),
    }
