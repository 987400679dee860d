"""The endpoints payloads come from, as plain data."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import render_url


@dataclass(frozen=True)
class Endpoint:
    name: str
    group: str
    path: str
    page_size: int | None = None
    optional: bool = False
    allow_empty: bool = True
    priority: int = 99
    sections: tuple[str, ...] = field(default=())

    @property
    def params(self) -> tuple[str, ...]:
        """The path's values, in the order in which requests name them."""
        return tuple(p for p in ("test_no", "vehicle_no", "occupant_location", "curve_no") if f"{{{p}}}" in self.path)

    @property
    def query(self) -> tuple[str, ...]:
        return ("pageNumber", "count") if self.page_size else ()


DB = "/vehicle-database-test-results"
# fixed values: names, groups, paths and page sizes of the public endpoints, and the merge priority of what they return
ENDPOINTS = [
    Endpoint("test_results", "discovery", DB, 100),
    Endpoint("search", "discovery", f"{DB}/by-search", 100),
    Endpoint("search_vehicle", "discovery_optional", f"{DB}/by-search-vehicle", optional=True),
    Endpoint("search_barrier", "discovery_optional", f"{DB}/by-search-barrier", optional=True),
    Endpoint("vehicle_models", "discovery_optional", f"{DB}/vehicleModels", optional=True),
    Endpoint("occupant_types", "discovery_optional", f"{DB}/occupant-types", optional=True),
    Endpoint("test_summary", "core", f"{DB}/test-no/{{test_no}}"),
    Endpoint("metadata_export", "core", f"{DB}/metadata/{{test_no}}", priority=4, sections=("TEST", "VEHICLE", "BARRIER", "OCCUPANT", "RESTRAINT", "INSTRUMENTATION", "URL", "REPORTS", "VIDEOS", "PHOTOS")),
    Endpoint("test_detail", "core_optional", f"{DB}/get-test-detail/{{test_no}}", optional=True, priority=3),
    Endpoint("vehicle_info", "detail", f"{DB}/get-vehicle-info/{{test_no}}"),
    Endpoint("vehicle_detail", "detail", f"{DB}/get-vehicle-detail-info/{{vehicle_no}}/{{test_no}}"),
    Endpoint("barrier_info", "detail", f"{DB}/get-barrier-info/{{test_no}}"),
    Endpoint("occupant_info", "detail", f"{DB}/get-occupant-info/{{test_no}}", priority=2),
    Endpoint("occupant_info_by_vehicle", "detail", f"{DB}/get-occupant-info/{{vehicle_no}}/{{test_no}}"),
    Endpoint("occupant_detail", "detail", f"{DB}/get-occupant-detail-information/{{vehicle_no}}/{{test_no}}/{{occupant_location}}", priority=1),
    Endpoint("restraint_info", "detail", f"{DB}/get-restraint-info/{{vehicle_no}}/{{test_no}}/{{occupant_location}}", priority=0),
    Endpoint("intrusion_info", "detail", f"{DB}/get-intrusion-info/{{vehicle_no}}/{{test_no}}"),
    Endpoint("instrumentation_info", "detail", f"{DB}/get-instrumentation-info/{{test_no}}", 20),
    Endpoint("instrumentation_detail", "detail", f"{DB}/get-instrumentation-detail-info/{{curve_no}}/{{test_no}}"),
    Endpoint("multimedia_files", "assets", f"{DB}/get-multimedia-files/{{test_no}}"),
    Endpoint("vehicle_documents", "assets", "/vehicle-documents/test-no/{test_no}"),
]
BY_NAME = {e.name: e for e in ENDPOINTS}


def endpoints(spark: SparkSession) -> DataFrame:
    """The registry as a table."""
    rows = [(e.name, e.group, e.path, list(e.params), e.page_size, e.optional, e.allow_empty, e.priority) for e in ENDPOINTS]
    return spark.createDataFrame(rows, "name string, endpoint_group string, path string, params array<string>, page_size int, optional boolean, allow_empty boolean, priority int")


def priority(endpoint: Column) -> Column:
    """Merge priority: lower overrides higher."""
    out = F.lit(99)
    for e in ENDPOINTS:
        if e.priority != 99:
            out = F.when(endpoint == e.name, e.priority).otherwise(out)
    return out


def url_for(name: str, base: str, **values: Column) -> Column:
    """The URL of an endpoint; a value that the path lacks is a query parameter."""
    e = BY_NAME[name]
    return F.concat(F.lit(base.rstrip("/")), render_url(e.path, [*[q for q in e.query if q in values], *[v for v in values if v not in e.params and v not in e.query]], values))
