"""Facets as bitmaps: a filter reads a bit for each entity and value it asks for, and only the entities that match.

``write_facet_index`` numbers the entities in order of their id. ``<path>/entities`` keeps them by shelf, a run of blocks of
32,768 ordinals; ``<path>/bitmaps`` has for each dimension, value and block the bits of the entities that show the value.
Values are stored as filters ask for them: a kind of ``both`` also under the single kinds, a taxonomy node also under all
above it, varieties by their key. So a filter is OR within a dimension and AND across, on equal values alone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cartolex.functions.text import normalize_variety
from cartolex.operators.facets import FacetColumns, Filters, sure

#: Blocks of a shelf, the folder that is read or left out as a whole: about a million entities.
SHELF_BLOCKS = 32
BITMAPS = "dim string, value string, shelf long, block long, bits binary"
ORDINAL, SHELF = "facet_ordinal", "facet_shelf"


def _values(at: FacetColumns) -> Column:
    """(dim, value) of everything a filter can ask of an entity, each once."""

    def tagged(dim: str, values: Column) -> Column:
        known = F.coalesce(values, F.array().cast("array<string>"))
        return F.transform(known, lambda v: F.struct(F.lit(dim).alias("dim"), v.alias("value")))

    def flag(dim: str, value: Column) -> Column:
        return tagged(dim, F.when(sure(value), F.array(F.lit("true"))))

    def with_parents(node: Column) -> Column:
        parts = F.split(node, "/")
        return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, 1, i), "/"))

    kind = F.col(at.kind)
    families = F.filter(at.flavor_families, lambda v: v.isNotNull())
    return F.array_distinct(
        F.concat(
            tagged("all", F.array(F.lit(""))),
            tagged("kind", F.when(kind == "both", F.array(F.lit("both"), F.lit("roaster"), F.lit("cafe"))).otherwise(F.array(kind))),
            flag("sells_online", F.col(at.sells_online)),
            flag("with_items", F.col(at.status) == at.with_items),
            *[tagged(dim, F.col(getattr(at, dim))) for dim in ("roast_levels", "processes", "origin_countries")],
            tagged("flavor_families", F.flatten(F.transform(families, with_parents))),
            tagged("varieties", F.transform(at.varieties, normalize_variety)),
            flag("has_decaf", F.col(at.has_decaf)),
        )
    )


def _terms(f: Filters) -> dict[str, list]:
    """The values asked for, by dimension. Without a filter all entities are asked for."""
    terms = {dim: list(getattr(f, dim)) for dim in ("roast_levels", "processes", "origin_countries", "flavor_families")}
    terms["kind"] = list(f.kinds)
    terms["varieties"] = [normalize_variety(F.lit(v)) for v in f.varieties]
    flags = {"sells_online": f.sells_online, "with_items": f.about_items, "has_decaf": f.decaf_only}
    terms.update({dim: ["true"] for dim, wanted in flags.items() if wanted})
    return {dim: values for dim, values in terms.items() if values} or {"all": [""]}


def write_facet_index(index: DataFrame, path: str, id: str = "id", at: FacetColumns = FacetColumns(), shelf_blocks: int = SHELF_BLOCKS) -> None:
    """Write the entities of ``index`` and their bitmaps to ``path``, which must be new.

    Ordinals are given in one write and read back from it, so a task that is run again can't number entities anew. A repeated
    row is an entity of its own; null lists and null members show no value.
    """
    spark = index.sparkSession
    index.limit(0).write.parquet(f"{path}/schema")
    rows = index.repartitionByRange(F.col(id)).sortWithinPartitions(id).withColumn(ORDINAL, F.monotonically_increasing_id() + 1)
    shelf = F.floor((F.bitmap_bucket_number(ORDINAL) - 1) / shelf_blocks)
    rows.withColumn(SHELF, shelf).sortWithinPartitions(SHELF, ORDINAL).write.partitionBy(SHELF).parquet(f"{path}/entities")
    shown = _entities(spark, path).select(
        F.col(SHELF).alias("shelf"),
        F.bitmap_bucket_number(ORDINAL).alias("block"),
        F.bitmap_bit_position(ORDINAL).alias("bit"),
        F.inline(_values(at)),
    )
    bits = shown.filter("value IS NOT NULL").groupBy("dim", "value", "shelf", "block").agg(F.bitmap_construct_agg("bit").alias("bits"))
    laid = bits.repartitionByRange("dim", "value", "block").sortWithinPartitions("dim", "value", "block")
    laid.write.partitionBy("dim").parquet(f"{path}/bitmaps")


def _entities(spark: SparkSession, path: str) -> DataFrame:
    schema = spark.read.parquet(f"{path}/schema").schema.add(ORDINAL, "long").add(SHELF, "long")
    return spark.read.schema(schema).parquet(f"{path}/entities")


def matching_bits(spark: SparkSession, path: str, f: Filters) -> DataFrame:
    """shelf, block and bits of the entities that pass ``f``, for blocks that have any."""
    terms = _terms(f)
    asked = F.lit(False)
    for dim, values in terms.items():
        asked = asked | ((F.col("dim") == dim) & F.col("value").isin(values))
    # Dealt by block once: neither of the two aggregations moves its rows again.
    hits = spark.read.schema(BITMAPS).parquet(f"{path}/bitmaps").filter(asked).repartition("block")
    one = hits.groupBy("dim", "shelf", "block").agg(F.bitmap_or_agg("bits").alias("bits"))
    both = one.groupBy("shelf", "block").agg(F.count("*").alias("met"), F.bitmap_and_agg("bits").alias("bits"))
    return both.filter((F.col("met") == len(terms)) & (F.bitmap_count("bits") > 0)).select("shelf", "block", "bits")


def count_by_bitmaps(spark: SparkSession, path: str, f: Filters) -> DataFrame:
    """``count_matching`` from the bitmaps alone."""
    total = F.coalesce(F.sum(F.bitmap_count("bits")), F.lit(0))
    return matching_bits(spark, path, f).agg(total.alias("matching")).withColumn("active", F.lit(f.active))


def filter_by_bitmaps(spark: SparkSession, path: str, f: Filters) -> DataFrame:
    """``apply_filters`` from the bitmaps; shelves without a match are not read.

    The driver gets the numbers of the shelves that match, at most one for a million entities: fewer than the files it lists.
    """
    found = matching_bits(spark, path, f)
    shelves = [r.shelf for r in found.select("shelf").distinct().collect()]
    entities = _entities(spark, path).filter(F.col(SHELF).isin(shelves))
    names = [c for c in entities.columns if c not in (ORDINAL, SHELF)]
    bits = found.select(F.col("block").alias("facet_block"), F.col("bits").alias("facet_bits"))
    joined = entities.withColumn("facet_block", F.bitmap_bucket_number(ORDINAL)).join(bits, "facet_block")
    bit = F.bitmap_bit_position(ORDINAL)
    octet = F.conv(F.hex(F.substring("facet_bits", F.floor(bit / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    return joined.filter(F.getbit(octet, F.pmod(bit, F.lit(8)).cast("int")) == 1).select(*[F.col(f"`{c}`") for c in names])
