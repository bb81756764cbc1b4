"""An index that is replaced as a whole: versioned folders, and a manifest whose appearance is the commit.

``<path>/data/<version>/`` holds the rows of one publication, by region, each region in order of the id. The manifests in
``<path>/manifests/`` are numbered; the last one says in which folder each region lies. A publication writes its folders, then
a manifest under a temporary name, and renames it to the next number: until then readers see the old index whole, and a run
that dies before leaves it. Readers look the last manifest up once, so what they read does not change under them.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Rows of a file, and bytes of a row group: a lookup reads one row group of one file.
ROWS_PER_FILE, GROUP_BYTES = 1_000_000, 8 << 20
#: Publications whose rows stay for readers that began before the last one.
KEPT = 2


class PublicationConflict(RuntimeError):
    """Somebody else published in the meantime: nothing was changed."""


def _store(spark: SparkSession, path: str):
    """Files below ``path``, wherever Spark keeps it: (file context, function from names to paths)."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
    root = hadoop.Path(path)
    full = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(root)
    context = hadoop.FileContext.getFileContext(full.toUri(), spark.sparkContext._jsc.hadoopConfiguration())
    return context, lambda *names: hadoop.Path(full, "/".join(names)) if names else full


def _versions(spark: SparkSession, path: str) -> list[int]:
    context, at = _store(spark, path)
    if not context.util().exists(at("manifests")):
        return []
    names = [s.getPath().getName() for s in context.util().listStatus(at("manifests"))]
    return sorted(int(n) for n in names if n.isdigit())


def _read(spark: SparkSession, path: str, version: int) -> dict:
    context, at = _store(spark, path)
    stream = context.open(at("manifests", f"{version:010d}"))
    try:
        return json.loads(spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
    finally:
        stream.close()


def manifest(spark: SparkSession, path: str) -> dict:
    """The index as it is now: version, schema, and the folder and rows of each region. Version 0 has none."""
    versions = _versions(spark, path)
    return _read(spark, path, versions[-1]) if versions else {"version": 0, "schema": None, "regions": {}}


def _commit(spark: SparkSession, path: str, content: dict) -> None:
    """Write a manifest and give it its number, unless that number is taken."""
    jvm = spark.sparkContext._jvm
    context, at = _store(spark, path)
    draft = at("manifests", f".draft-{uuid.uuid4().hex}")
    flags = jvm.java.util.EnumSet.of(jvm.org.apache.hadoop.fs.CreateFlag.CREATE)
    parents = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.CreateOpts, 1)
    parents[0] = getattr(jvm.org.apache.hadoop.fs.Options.CreateOpts, "createParent")()
    stream = context.create(draft, flags, parents)
    stream.write(bytearray(json.dumps(content, sort_keys=True).encode()))
    stream.close()
    try:
        # Without options a rename never replaces a file.
        context.rename(draft, at("manifests", f"{content['version']:010d}"), spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0))
    except Exception as err:
        context.delete(draft, False)
        if "FileAlreadyExists" in str(err):
            raise PublicationConflict(f"version {content['version']} of {path} is there already") from err
        raise


def publish(
    index: DataFrame, path: str, region: str = "region_id", id: str = "id", regions: Sequence[str] | None = None, rows_per_file: int = ROWS_PER_FILE,
    group_bytes: int = GROUP_BYTES, based_on: int | None = None,
) -> int:
    """Replace the regions present in ``index``, and empty those of ``regions`` that have no rows, all at once.

    Returns the new version. Every region's rows lie in order of ``id``, with a Bloom filter of it in each row group.
    ``based_on`` is the version the rows were made from (default: the one found now); if another was published since, or is
    while this one is written, PublicationConflict is raised and the index stays as it is. Rows without a region are left out.
    """
    spark = index.sparkSession
    old = manifest(spark, path)
    if based_on is not None and old["version"] != based_on:
        raise PublicationConflict(f"{path} is at version {old['version']}, not {based_on}")
    folder = f"data/{old['version'] + 1:010d}-{uuid.uuid4().hex}"
    where = _store(spark, path)[1](*folder.split("/")).toString()
    rows = index.filter(F.col(region).isNotNull()).withColumn("_region", F.col(region).cast("string")).drop(region)
    # Ranges of (region, id): a file has one region but at range ends, and each region's files follow each other.
    written = rows.repartitionByRange("_region", id).sortWithinPartitions("_region", id).write
    written = written.option("maxRecordsPerFile", rows_per_file).option("parquet.block.size", group_bytes).option("compression", "zstd")
    written.option(f"parquet.bloom.filter.enabled#{id}", "true").option(f"parquet.bloom.filter.expected.ndv#{id}", min(rows_per_file, 100_000)).partitionBy("_region").parquet(where)
    stored = spark.read.schema(rows.schema).option("basePath", where).parquet(where)
    counts = {r[0]: r[1] for r in stored.groupBy("_region").count().collect()}
    held = {r: v for r, v in old["regions"].items() if r not in set(regions or ())}
    held |= {r: {"folder": folder, "rows": n} for r, n in counts.items()}
    content = {"version": old["version"] + 1, "schema": rows.drop("_region").schema.json(), "region": region, "regions": held}
    _commit(spark, path, content)
    clean(spark, path)
    return content["version"]


def clean(spark: SparkSession, path: str, kept: int = KEPT) -> list[str]:
    """Drop folders that none of the last ``kept`` manifests names, and older manifests. Returns the folders.

    Folders of a version beyond the last manifest belong to a publication that is under way, or died: they stay until a later
    version has been committed.
    """
    context, at = _store(spark, path)
    versions = _versions(spark, path)
    live = {v["folder"] for version in versions[-kept:] for v in _read(spark, path, version)["regions"].values()}
    gone = []
    if context.util().exists(at("data")):
        for status in context.util().listStatus(at("data")):
            name = status.getPath().getName()
            if f"data/{name}" not in live and versions and int(name.split("-")[0]) < versions[-1]:
                context.delete(status.getPath(), True)
                gone.append(f"data/{name}")
    for version in versions[:-kept]:
        context.delete(at("manifests", f"{version:010d}"), False)
    return gone


def read_published(spark: SparkSession, path: str, regions: Sequence[str] | None = None, at: dict | None = None) -> DataFrame | None:
    """The rows of some regions (None: of all) as of one manifest, the last unless ``at`` gives another. None before the first."""
    found = at or manifest(spark, path)
    if found["schema"] is None:
        return None
    schema = T.StructType.fromJson(json.loads(found["schema"]))
    region = found["region"]
    wanted = [r for r in found["regions"] if regions is None or r in set(regions)]
    out = None
    for folder in sorted({found["regions"][r]["folder"] for r in wanted}):
        own = [r for r in wanted if found["regions"][r]["folder"] == folder]
        root = _store(spark, path)[1](*folder.split("/")).toString()
        full = T.StructType([*schema.fields, T.StructField("_region", T.StringType())])
        # The filter prunes the folders of regions that a later publication replaced.
        rows = spark.read.schema(full).option("basePath", root).parquet(root).filter(F.col("_region").isin(own)).withColumnRenamed("_region", region)
        out = rows if out is None else out.unionByName(rows)
    if out is None:
        out = spark.createDataFrame([], T.StructType([*schema.fields, T.StructField(region, T.StringType())]))
    return out


def find(spark: SparkSession, path: str, value, id: str = "id", regions: Sequence[str] | None = None) -> DataFrame | None:
    """Rows with this id. Ranges and Bloom filters of row groups leave few to be read."""
    rows = read_published(spark, path, regions)
    return None if rows is None else rows.filter(F.col(id) == F.lit(value))
