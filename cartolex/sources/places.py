"""Place scans over nested Parquet."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cartolex.functions.geo import geohash

Box = tuple[float, float, float, float]


def read_places(spark: SparkSession, path: str, release: str | None = None) -> DataFrame:
    """Parquet scan; ``{release}`` in the path is filled in, ``key=value`` folders become columns."""
    return spark.read.parquet(path.replace("{release}", release) if release else path)


def inside_box(box: Box, bounds: str = "bbox") -> Column:
    """Bounds fully contained in the box; plain comparisons so that Parquet can skip row groups."""
    west, south, east, north = (float(v) for v in box)
    return (
        (F.col(f"{bounds}.xmin") >= west)
        & (F.col(f"{bounds}.xmax") <= east)
        & (F.col(f"{bounds}.ymin") >= south)
        & (F.col(f"{bounds}.ymax") <= north)
    )


#: Letters of the cell that orders places, bytes of a row group and rows of a file.
CELL_LETTERS, GROUP_BYTES, ROWS_PER_FILE = 10, 8 << 20, 1_000_000


def write_places(places: DataFrame, path: str, bounds: str = "bbox", rows_per_file: int = ROWS_PER_FILE, group_bytes: int = GROUP_BYTES) -> None:
    """Store nested places along a Z-curve of their centres, so that a row group covers a small patch of the map.

    The statistics of a row group then say whether a box can meet it, and a scan of a box reads the groups near it alone.
    Files are ranges of the curve; places at one spot may share several. Places without bounds lie together at the start.
    """
    centre = [(F.col(f"{bounds}.{low}") + F.col(f"{bounds}.{high}")).cast("double") / 2 for low, high in (("ymin", "ymax"), ("xmin", "xmax"))]
    cell = F.coalesce(geohash(*centre, CELL_LETTERS), F.lit(""))
    ordered = places.withColumn("_cell", cell).withColumn("_mix", F.xxhash64(F.to_json(F.col(bounds)), F.monotonically_increasing_id()))
    ordered = ordered.repartitionByRange("_cell", "_mix").sortWithinPartitions("_cell").drop("_cell", "_mix")
    out = ordered.write.option("maxRecordsPerFile", rows_per_file).option("parquet.block.size", group_bytes).option("compression", "zstd")
    out.mode("errorifexists").parquet(path)


def _strings(c: Column) -> Column:
    return F.filter(F.coalesce(c, F.array().cast("array<string>")), lambda x: x.isNotNull())


def _finite(c: Column) -> Column:
    number = c.try_cast("double")
    return F.when(~F.isnan(number) & (F.abs(number) != float("inf")), number)


def scan_bbox(places: DataFrame, box: Box, primary: Sequence[str], alternates: Sequence[str]) -> DataFrame:
    """Flat rows of the places inside ``box`` whose category or alternate category is wanted."""
    others = F.coalesce(F.col("taxonomy.alternates"), F.array().cast("array<string>"))
    wanted = F.col("taxonomy.primary").isin(list(primary)) | F.exists(others, lambda c: c.isin(list(alternates)))
    address = F.get(F.col("addresses"), F.lit(0))
    return (
        places.filter(inside_box(box))
        .filter(F.coalesce(wanted, F.lit(False)))
        .select(
            F.col("id").cast("string").alias("id"),
            F.col("names.primary").alias("name"),
            F.col("taxonomy.primary").alias("category"),
            F.col("taxonomy.alternates").alias("alternates"),
            F.col("confidence"),
            F.col("websites"),
            F.col("socials"),
            F.col("phones"),
            F.col("brand.names.primary").alias("brand"),
            address["freeform"].alias("street"),
            address["locality"].alias("locality"),
            address["region"].alias("region"),
            address["postcode"].alias("postcode"),
            F.col("operating_status"),
            ((F.col("bbox.xmin") + F.col("bbox.xmax")) / 2).cast("double").alias("lng"),
            ((F.col("bbox.ymin") + F.col("bbox.ymax")) / 2).cast("double").alias("lat"),
        )
    )


def coerce_places(flat: DataFrame) -> DataFrame:
    """Boundary cleaning: empty strings to NULL, NULL list members dropped, numbers finite."""
    texts = ["name", "category", "brand", "street", "locality", "region", "postcode", "operating_status"]
    lists = ["alternates", "websites", "socials", "phones"]
    return flat.withColumns(
        {c: F.nullif(F.col(c), F.lit("")) for c in texts}
        | {c: _strings(F.col(c)) for c in lists}
        | {c: _finite(F.col(c)) for c in ("confidence", "lng", "lat")}
    )


def inspect_categories(
    df: DataFrame, category: Column, name: Column, name_pattern: str, category_likes: Sequence[str], k: int | None = None, box: tuple[float, float, float, float] | None = None
) -> DataFrame:
    """Categories of rows whose name or category looks relevant, most frequent first; the first ``k`` if that is given.

    ``box`` (west, south, east, north) keeps rows of nested place data whose box lies inside.
    """
    if box is not None:
        df = df.filter(inside_box(box))
    relevant = F.lower(name).rlike(name_pattern)
    for pattern in category_likes:
        relevant = relevant | category.ilike(pattern)
    counts = (
        df.filter(F.coalesce(relevant, F.lit(False)))
        .groupBy(category.alias("category"))
        .agg(F.count("*").alias("n"), F.min(name).alias("example"))
        .orderBy(F.desc("n"), "category")
    )
    return counts if k is None else counts.limit(k)
