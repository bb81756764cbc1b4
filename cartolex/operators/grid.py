"""Spatial summaries and nearest-region lookup."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cartolex.functions.geo import geohash, haversine_km, mercator_tile
from cartolex.vocab.enums import NEAR_ME_KM
from cartolex.vocab.regions import REGIONS, Region

CLUSTER_RADIUS_PX = 44
TILE_PX = 512
CLUSTER_MAX_ZOOM = 14


def bounds_of(points: DataFrame, lng: str = "lng", lat: str = "lat") -> DataFrame:
    """West, south, east and north; all NULL on an empty input."""
    return points.agg(
        F.min(lng).alias("west"), F.min(lat).alias("south"), F.max(lng).alias("east"), F.max(lat).alias("north")
    )


def geohash_cells(points: DataFrame, precision: int, lng: str = "lng", lat: str = "lat") -> DataFrame:
    return points.groupBy(geohash(F.col(lat), F.col(lng), precision).alias("cell")).agg(F.count("*").alias("points"))


def grid_clusters(points: DataFrame, zoom: int, lng: str = "lng", lat: str = "lat") -> DataFrame:
    """Count and centre of the points per map cell of about one cluster radius.

    A fixed grid, not the hierarchical greedy clustering of a map library. At
    the highest zooms points are not clustered.
    """
    x, y = mercator_tile(F.col(lng), F.col(lat), zoom, max(TILE_PX // CLUSTER_RADIUS_PX, 1))
    if zoom > CLUSTER_MAX_ZOOM:
        one = F.lit(1).cast("bigint").alias("points")
        return points.select(x.alias("x"), y.alias("y"), one, F.col(lng).cast("double").alias("lng"), F.col(lat).cast("double").alias("lat"))
    return points.groupBy(x.alias("x"), y.alias("y")).agg(
        F.count("*").alias("points"), F.avg(lng).alias("lng"), F.avg(lat).alias("lat")
    )


def nearest_region(
    points: DataFrame, lng: Column, lat: Column, regions: Sequence[Region] = REGIONS, radius_km: float = NEAR_ME_KM
) -> DataFrame:
    """Add ``region_id``, ``km`` and ``in_range``; of equally near regions the first listed wins.

    The regions are a short literal list, compared inside the row: no join.
    """
    offers = F.array(
        *[
            F.struct(
                haversine_km(lng, lat, F.lit(r.center[0]), F.lit(r.center[1])).alias("km"),
                F.lit(i).alias("ord"),
                F.lit(r.id).alias("id"),
            )
            for i, r in enumerate(regions)
        ]
    )
    best = points.withColumn("_best", F.array_min(offers))
    return best.withColumns(
        {"region_id": F.col("_best.id"), "km": F.col("_best.km"), "in_range": F.col("_best.km") <= radius_km}
    ).drop("_best")


def regions_by_state(regions: DataFrame) -> DataFrame:
    """(state, regions): both sorted by name."""
    return (
        regions.groupBy("state")
        .agg(F.array_sort(F.collect_list(F.struct("name", "region_id"))).alias("_r"))
        .select("state", F.transform("_r", lambda r: r["region_id"]).alias("regions"))
        .orderBy("state")
    )
