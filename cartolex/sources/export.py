"""JSON and GeoJSON output."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cartolex.operators.facets import tier


def write_json(df: DataFrame, path: str, region: str = "region_id") -> None:
    """One JSON document per line, a folder per region."""
    df.write.option("partitionOverwriteMode", "dynamic").mode("overwrite").partitionBy(region).json(path)


def to_geojson(index: DataFrame, id: Column | None = None) -> DataFrame:
    """One GeoJSON Feature per row (newline-delimited); rank 0 is drawn on top."""
    key = F.col("id") if id is None else id
    feature = F.struct(
        F.lit("Feature").alias("type"),
        key.alias("id"),
        F.struct(F.lit("Point").alias("type"), F.array("lng", "lat").alias("coordinates")).alias("geometry"),
        F.struct(
            key.alias("id"),
            F.col("name"),
            F.col("data_status").alias("status"),
            tier(F.col("data_status")).alias("rank"),
        ).alias("properties"),
    )
    return index.select(key.alias("id"), F.to_json(feature).alias("feature"))
