"""Landed pages as walks: which pages a walk takes, and whether it came to its end."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def page_parts(payload: Column) -> dict[str, Column]:
    """count, total and next_url of a payload (VARIANT), and whether it says anything of pages at all."""
    at = "$.meta.pagination"
    return {
        "paged": F.coalesce(F.schema_of_variant(F.try_variant_get(payload, at, "variant")).startswith("OBJECT"), F.lit(False)),
        "count": F.coalesce(F.try_variant_get(payload, f"{at}.count", "long"), F.lit(0)),
        "total": F.coalesce(F.try_variant_get(payload, f"{at}.total", "long"), F.lit(0)),
        "next_url": F.nullif(F.try_variant_get(payload, f"{at}.nextUrl", "string"), F.lit("")),
    }


def walked(pages: DataFrame, key: list[str], order: list[str], first: int = 0) -> DataFrame:
    """Pages that a walk over landed pages takes, in order: from the first on, up to a gap or to a page that ends it.

    pages: the key of the walk, page, paged, count, total, next_url.  Of a page that was landed several times the first by `order` counts.
    Adds taken_rows (so far) and ended (on the last page taken): complete, no_pagination or missing.  Walks without their first page give
    no rows (see `walks`).  A walk is one key of the window: its pages, not their rows."""
    once = Window.partitionBy(*key, "page").orderBy(*order)
    single = pages.where(F.col("page") >= first).withColumn("_n", F.row_number().over(once)).where("_n = 1").drop("_n")
    along = Window.partitionBy(*key).orderBy("page")
    so_far = along.rowsBetween(Window.unboundedPreceding, 0)
    counted = single.withColumn("_in_row", F.row_number().over(along) - 1 + first == F.col("page")).withColumn("taken_rows", F.sum("count").over(so_far))
    last = F.when(~F.col("paged"), "no_pagination").when(F.col("next_url").isNull() & (F.col("taken_rows") >= F.col("total")), "complete")
    ended = counted.where("_in_row").withColumn("ended", last)
    open_ = ended.withColumn("_over", F.coalesce(F.max(F.col("ended").isNotNull()).over(along.rowsBetween(Window.unboundedPreceding, -1)), F.lit(False))).where("not _over")
    final = F.lead("page").over(along).isNull()
    return open_.withColumn("ended", F.when(final, F.coalesce("ended", F.lit("missing")))).drop("_in_row", "_over")


def walks(wanted: DataFrame, pages: DataFrame, key: list[str], order: list[str], first: int = 0) -> DataFrame:
    """Per wanted walk: pages and rows taken, the total that its last page names, and how it ended (not_found without a first page)."""
    taken = walked(pages, key, order, first)
    by = taken.groupBy(*key).agg(F.count(F.lit(1)).alias("page_count"), F.max("taken_rows").alias("row_count"), F.max_by("total", "page").alias("total"), F.max("ended").alias("ended"))
    out = wanted.select(*key).distinct().join(by, key, "left")
    return out.select(*key, *[F.coalesce(c, F.lit(0)).alias(c) for c in ("page_count", "row_count")], "total", F.coalesce("ended", F.lit("not_found")).alias("ended"))
