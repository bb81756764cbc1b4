"""Path-style taxonomies: ``parent/child`` ids."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def top_of(id: Column) -> Column:
    return F.split(id, "/")[0]


def roots(taxonomy: DataFrame) -> DataFrame:
    return taxonomy.filter(~F.col("id").contains("/"))


def children(taxonomy: DataFrame, id: str) -> DataFrame:
    return taxonomy.filter(F.col("id").startswith(f"{id}/"))


