"""Objects at any depth of JSON payloads, in document order."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import session


def _nested(text: Column) -> Column:
    """Whether a text may be that of an object or a list."""
    return F.coalesce(F.ltrim(text).substr(1, 1).isin("{", "["), F.lit(False))


def _children(level: DataFrame, key: list[str]) -> DataFrame:
    """The objects and lists right below the nodes of a level: key, path, node.  Texts that look like JSON are texts."""
    v = F.try_parse_json("node")
    # the text keeps the order of keys, which VARIANT does not; VARIANT knows a text from an object, and is asked only where a text looks like one
    of_object = level.where("node like '{%'").select(*key, "path", "node", F.from_json("node", "map<string,string>").alias("m"))
    of_object = of_object.select(*key, "path", F.posexplode(F.map_entries("m")).alias("at", "e"), F.when(F.exists(F.map_values("m"), _nested), F.try_variant_get(v, "$", "map<string,variant>")).alias("typed"))
    of_list = level.where("node like '[%'").select(*key, "path", "node", F.from_json("node", "array<string>").alias("m"))
    of_list = of_list.select(*key, "path", F.posexplode("m").alias("at", "text"), F.when(F.exists("m", _nested), F.try_variant_get(v, "$", "array<variant>")).alias("typed"))
    objects = of_object.where(_nested(F.col("e.value"))).select(*key, "path", "at", F.col("e.value").alias("text"), F.try_element_at("typed", F.col("e.key")).alias("typed"))
    both = objects.unionByName(of_list.where(_nested(F.col("text"))).select(*key, "path", "at", "text", F.get("typed", F.col("at")).alias("typed")))
    kind = F.schema_of_variant("typed")
    return both.where(kind.startswith("OBJECT") | kind.startswith("ARRAY")).select(*key, F.concat("path", F.array("at")).alias("path"), F.trim("text").alias("node"))


def first_object(payloads: DataFrame, key: list[str], body: str, wanted: Callable[[Column], Column]) -> DataFrame:
    """key, path, node (JSON text) and depth of the first object in document order, at any depth, that `wanted` (of the object as VARIANT) holds for.

    key: columns that tell payloads apart.  The walk goes down level by level, all payloads at once, until no object or list is left: as many jobs as the deepest payload has
    levels, each over what the level before has written; below an object that was found nothing is looked at.  An object comes before those inside it, and what stands first in the text comes first.  Payloads that are no JSON (or repeat
    a key in an object), and those without such an object, give no row."""
    spark = payloads.sparkSession
    folder = session.workspace(spark)
    level = payloads.where(F.try_parse_json(body).isNotNull()).select(*key, F.array().cast("array<int>").alias("path"), F.trim(body).alias("node"))
    depth, hits = 0, []
    while True:
        path = f"{folder}/level={depth}"
        # only objects are parsed for the condition, which is told once, as a level is written; it is null and thus false of lists
        told = level.withColumn("_v", F.try_parse_json(F.when(F.col("node").startswith("{"), F.col("node"))))
        told = told.select(*key, "path", "node", (F.col("_v").isNotNull() & F.coalesce(wanted(F.col("_v")), F.lit(False))).alias("_hit"))
        told.write.parquet(path)
        stored = spark.read.schema(told.schema).parquet(path)
        if stored.isEmpty():
            break
        hits.append(stored.where("_hit").select(*key, "path", "node"))
        level = _children(stored.where("not _hit"), key)
        depth += 1
    out = payloads.select(*key, F.array().cast("array<int>").alias("path"), F.lit("").alias("node")).limit(0)
    for h in hits:
        out = out.unionByName(h)
    first = out.groupBy(*key).agg(F.min("path").alias("path"), F.min_by("node", "path").alias("node")).withColumn("depth", F.size("path"))
    first.write.parquet(f"{folder}/found")
    found = spark.read.schema(first.schema).parquet(f"{folder}/found")
    hadoop = spark._jvm.org.apache.hadoop.fs
    for d in range(depth + 1):
        at = hadoop.Path(f"{folder}/level={d}")
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
    return found
