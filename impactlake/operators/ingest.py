"""Raw layer: content-addressed payloads, observations, exploded rows with lineage, sections, field catalog."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.registry import BY_NAME

PAYLOAD_KEY = ["endpoint_name", "canonical_url_hash", "payload_hash"]


def new_payloads(incoming: DataFrame, stored: DataFrame | None = None, key: list[str] = PAYLOAD_KEY, order: list[str] | None = None) -> DataFrame:
    """Incoming rows whose key is not stored yet, one a key: the first by `order`."""
    first = Window.partitionBy(*key).orderBy(*(order or key))
    fresh = incoming.withColumn("_n", F.row_number().over(first)).where("_n = 1").drop("_n")
    return fresh if stored is None else fresh.join(stored.select(*key), key, "left_anti")


def observation_counts(observations: DataFrame, key: list[str], at: str) -> DataFrame:
    """How often, first and last each payload was seen."""
    return observations.groupBy(*key).agg(F.count(F.lit(1)).alias("observation_count"), F.min(at).alias("first_seen"), F.max(at).alias("last_seen"))


def explode_results(payloads: DataFrame, payload: str = "payload") -> DataFrame:
    """A row for each object in results, with its path; entries that are no objects are left out, positions are kept.

    Needs endpoint_name; other columns come along."""
    keep = [c for c in payloads.columns if c != payload]
    rows = payloads.select(*keep, F.posexplode(F.try_variant_get(payload, "$.results", "array<variant>")).alias("pos", "data"))
    rows = rows.where(F.schema_of_variant("data").startswith("OBJECT"))
    path = F.concat(F.lit("$.results["), F.col("pos").cast("string"), F.lit("]"))
    return rows.select(*keep, F.col("endpoint_name").alias("section"), path.alias("json_path"), F.sha2(F.to_json("data"), 256).alias("row_hash"), "data")


def explode_sections(payloads: DataFrame, payload: str = "payload", sections: tuple[str, ...] = BY_NAME["metadata_export"].sections) -> DataFrame:
    """A row for each object of each known section of a sectioned export."""
    keep = [c for c in payloads.columns if c != payload]
    one = payloads.select(*keep, F.posexplode(F.try_variant_get(payload, "$.results", "array<variant>")).alias("pos", "result"))
    named = F.array(*[F.struct(F.lit(s).alias("section"), F.coalesce(F.try_variant_get("result", f"$.{s}", "array<variant>"), F.when(F.schema_of_variant(F.try_variant_get("result", f"$.{s}", "variant")).startswith("OBJECT"), F.array(F.try_variant_get("result", f"$.{s}", "variant")))).alias("rows")) for s in sections])
    each = one.select(*keep, "pos", F.explode(named).alias("s")).select(*keep, "pos", F.col("s.section").alias("section"), F.posexplode("s.rows").alias("i", "data"))
    each = each.where(F.schema_of_variant("data").startswith("OBJECT"))
    path = F.concat(F.lit("$.results["), F.col("pos").cast("string"), F.lit("]."), "section", F.lit("["), F.col("i").cast("string"), F.lit("]"))
    return each.select(*keep, "section", path.alias("json_path"), F.sha2(F.to_json("data"), 256).alias("row_hash"), "data")


def exploded_rows(payloads: DataFrame, payload: str = "payload") -> DataFrame:
    """Both shapes of payloads as rows with lineage."""
    export = F.col("endpoint_name") == "metadata_export"
    return explode_results(payloads.where(~export), payload).unionByName(explode_sections(payloads.where(export), payload))


def section_counts(rows: DataFrame) -> DataFrame:
    return rows.groupBy("endpoint_name", "section").agg(F.count(F.lit(1)).alias("row_count"), F.min("json_path").alias("first_path"))


def field_observations(rows: DataFrame, data: str = "data", mapping: dict[str, str] | None = None) -> DataFrame:
    """A row for each key of each object: its name, value type and whether it holds anything; with the column it maps to."""
    keys = F.map_entries(F.try_variant_get(data, "$", "map<string,variant>"))
    out = rows.select("endpoint_name", "section", F.explode(keys).alias("e")).select("endpoint_name", "section", F.col("e.key").alias("field_name"), F.regexp_extract(F.schema_of_variant("e.value"), r"^\w+", 0).alias("observed_type"), (~F.is_variant_null("e.value")).alias("non_null"), F.substring(F.to_json("e.value"), 1, 120).alias("example"))
    if mapping is None:
        return out
    table = F.create_map(*[F.lit(x) for kv in mapping.items() for x in kv])
    return out.withColumn("mapped_to", table[F.concat_ws(".", "section", "field_name")])


def field_catalog(observed: DataFrame, key: list[str], order: str | None = None, examples: int = 5) -> DataFrame:
    """Seen and non-null counts of each field, with some examples.

    The examples are the least by text (or by `order`), so no arrival order is needed and no group is gathered whole:
    each example is counted first, then ranked."""
    sample = observed.where("example is not null").groupBy(*key, "example").agg(F.min(order or "example").alias("_o"))
    rank = Window.partitionBy(*key).orderBy("_o", "example")
    some = sample.withColumn("_n", F.row_number().over(rank)).where(F.col("_n") <= examples).groupBy(*key).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_n", "example"))), lambda x: x["example"]), "|").alias("examples"))
    counts = observed.groupBy(*key).agg(F.count(F.lit(1)).alias("seen_count"), F.count_if("non_null").alias("non_null_count"))
    return counts.join(some, key, "left")


def json_keys(text: Column) -> Column:
    """The keys of a JSON object in a text column."""
    return F.coalesce(F.json_object_keys(text), F.array().cast("array<string>"))


# fixed values: columns that a request can supply, and the keys under which a row has them itself
CONTEXT = {"test_no": ("testNo", "TSTNO"), "vehicle_no": ("vehicleNo", "VEHNO"), "occupant_location": ("occupantLocation", "OCCLOC", "OCCLOCD")}


def with_request_context(rows: DataFrame, aliases: dict[str, tuple[str, ...]] = CONTEXT, endpoint: str = "restraint_info") -> DataFrame:
    """Columns of the request (request_test_no, ...) as fallbacks where a restraint's row has none of their keys; a key that is there counts even if it is null.

    Rows of other endpoints have what they hold themselves."""
    from ..functions.presence import any_present, first_present

    out = rows
    for column, keys in aliases.items():
        context = F.col(f"request_{column}").cast("string") if f"request_{column}" in rows.columns else F.lit(None).cast("string")
        asked = F.when(F.col("endpoint_name") == endpoint, context)
        out = out.withColumn(f"context_{column}", F.when(any_present(F.col("data"), keys), first_present(F.col("data"), keys)).otherwise(asked))
    return out
