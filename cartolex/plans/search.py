"""Read side: the places that match a selection, best first."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cartolex.functions.geo import haversine_km
from cartolex.operators.facets import FacetColumns, Filters, apply_filters, sort_entities
from cartolex.sources.snapshots import load_index


def search(
    index: DataFrame,
    filters: Filters = Filters(),
    point: tuple[float, float] | None = None,
    limit: int | None = None,
    at: FacetColumns = FacetColumns(),
) -> DataFrame:
    """Filter, add ``km`` from ``point`` and sort. With ``limit`` the sort becomes a top-k."""
    found = apply_filters(index, filters, at)
    if point is not None:
        found = found.withColumn("km", haversine_km(F.lit(point[0]), F.lit(point[1]), F.col("lng"), F.col("lat")))
    ordered = sort_entities(found, point)
    return ordered if limit is None else ordered.limit(limit)


def search_region(
    spark: SparkSession,
    path: str,
    region_id: str,
    filters: Filters = Filters(),
    point: tuple[float, float] | None = None,
) -> DataFrame:
    return search(load_index(spark, path, region_id), filters, point)
