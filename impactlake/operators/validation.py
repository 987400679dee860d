"""Seeds against what endpoints say of them now: lookups in stages, each of which asks only for what earlier ones left open."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import session
from ..functions import dates, presence
from . import descent

# fixed values: keys under which payloads name a test and what is compared of it
TEST_NO = ("testNo", "TSTNO", "test_no")
IDENTITY = {
    "live_date_raw": (("testDate", "TSTDAT", "test_date"), "string"),
    "live_test_configuration": (("testConfiguration", "TSTCFND", "crash_type"), "string"),
    "live_test_type": (("testType", "TSTTYPD"), "string"),
    "live_model_year": (("modelYear", "vehicleModelYear", "YEAR"), "string"),
    "live_vehicle_make": (("vehicleMake", "make", "MAKED"), "string"),
    "live_vehicle_model": (("vehicleModel", "model", "MODELD"), "string"),
}
COMPARED = ("test_configuration", "test_type", "model_year", "vehicle_make", "vehicle_model")
# fixed values: what a status means for the authoritative list
AUTHORITY = {
    "excluded_not_live_validated": "excluded_not_live_validated",
    "excluded_date_missing_or_parse_failed": "excluded_date_conflict",
    "excluded_out_of_scope": "excluded_out_of_scope",
    "date_conflict": "excluded_date_conflict",
    "validated_live_with_metadata_drift": "authoritative_included",
    "validated_live": "authoritative_included",
}
Ask = Callable[[str, DataFrame], DataFrame]


def from_cache(responses: DataFrame) -> Ask:
    """Asks stored responses (endpoint, test_no, http_status, body); what they lack is not answered."""
    return lambda endpoint, tests: responses.where(F.col("endpoint") == endpoint).join(tests, "test_no", "left_semi").select("test_no", "http_status", "body")


def drift(seed: dict[str, Column], live: dict[str, Column]) -> Column:
    """Names of fields that both sides fill and that differ, blanks at the ends and case aside."""
    differs = []
    for name in COMPARED:
        a, b = (F.coalesce(side[name].cast("string"), F.lit("")) for side in (seed, live))
        differs.append(F.when((a != "") & (b != "") & (F.upper(F.trim(a)) != F.upper(F.trim(b))), name))
    return F.array_compact(F.array(*differs))


def validate(seeds: DataFrame, ask: Ask, endpoints: Sequence[str], least: str) -> DataFrame:
    """Per seed (test_no, test_date, and the compared fields): what was asked, the identity that was found and where, the status and what drifts.

    An endpoint ends the search for a seed if it names the test with a date that can be read; an identity without one is kept until a later endpoint
    names the test again.  attempted: endpoint, http_status (null: not answered) and rows of the payload, in the order of asking.  Seeds are one a test_no."""
    spark = seeds.sparkSession
    folder = session.workspace(spark)

    def kept(df: DataFrame, name: str) -> DataFrame:
        df.write.parquet(f"{folder}/{name}")
        return spark.read.schema(df.schema).parquet(f"{folder}/{name}")

    open_, tries, found = kept(seeds.select("test_no").distinct(), "seeds"), None, None
    for stage, endpoint in enumerate(endpoints):
        answers = kept(ask(endpoint, open_), f"answers{stage}")
        rows = F.coalesce(F.size(F.try_variant_get(F.try_parse_json("body"), "$.results", "array<variant>")), F.lit(0))
        said = open_.join(answers, "test_no", "left").select("test_no", F.lit(stage).alias("stage"), F.struct(F.lit(endpoint).alias("endpoint"), "http_status", F.when(F.col("http_status").isNotNull(), rows).alias("row_count")).alias("attempt"))
        tries = said if tries is None else tries.unionByName(said)
        good = answers.where("body is not null and coalesce(http_status, 0) < 400").withColumn("about", F.col("test_no"))
        of_test = lambda v: presence.first_present(v, TEST_NO, "long") == F.col("test_no")
        hit = descent.first_object(good, ["test_no"], "body", of_test).withColumn("_v", F.parse_json("node"))
        named = hit.select("test_no", F.lit(stage).alias("stage"), F.lit(endpoint).alias("validation_endpoint"), *[presence.first_present(F.col("_v"), keys, kind).alias(name) for name, (keys, kind) in IDENTITY.items()])
        named = kept(named.withColumn("live_date", dates.any_date(F.col("live_date_raw"))), f"named{stage}")
        found = named if found is None else found.unionByName(named)
        if stage + 1 < len(endpoints):
            open_ = kept(open_.join(named.where("live_date is not null"), "test_no", "left_anti"), f"open{stage}")
    last = found.groupBy("test_no").agg(F.max_by(F.struct(*[c for c in found.columns if c not in ("test_no", "stage")]), "stage").alias("live"))
    order = F.array_sort(F.collect_list(F.struct("stage", "attempt")))  # a row an endpoint
    asked = tries.groupBy("test_no").agg(F.transform(order, lambda x: x["attempt"]).alias("attempted"))
    both = seeds.join(asked, "test_no", "left").join(last, "test_no", "left").select(*seeds.columns, "attempted", "live.*")
    lo, live = F.lit(least).cast("date"), F.col("live_date")
    differing = drift({c: F.col(c) for c in COMPARED}, {c: F.col(f"live_{c}") for c in COMPARED})
    status = (
        F.when(F.col("validation_endpoint").isNull(), "excluded_not_live_validated")
        .when(live.isNull(), "excluded_date_missing_or_parse_failed")
        .when(live < lo, "excluded_out_of_scope")
        .when(~live.eqNullSafe(F.col("test_date")), "date_conflict")
        .when(F.size(differing) > 0, "validated_live_with_metadata_drift")
        .otherwise("validated_live")
    )
    told = both.withColumn("validation_status", status)
    authority = F.create_map(*[F.lit(x) for pair in AUTHORITY.items() for x in pair])
    included = F.col("validation_status").startswith("validated")
    return told.withColumn("authority_status", authority[F.col("validation_status")]).withColumn("drift_fields", F.when(included, differing).otherwise(F.array().cast("array<string>")))


def authoritative(validated: DataFrame) -> DataFrame:
    """The seeds that count, with what is known of them now."""
    return validated.where("authority_status = 'authoritative_included'")
