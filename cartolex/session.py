"""Session settings and durable lineage cuts."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession

# AQE re-plans from measured sizes: it picks broadcast joins, coalesces small
# partitions and splits skewed ones, so no operator here hard-codes a strategy.
DEFAULTS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.sources.partitionOverwriteMode": "dynamic",
    # Checkpoints that nothing reads any more go away.
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
}


def build_session(app: str = "cartolex", master: str | None = None, **extra: str) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**DEFAULTS, **extra}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Folder for durable lineage cuts.

    A cluster names a shared folder in ``spark.checkpoint.dir``. Only a local
    master, where every task sees the same disk, may fall back to a new folder.
    """
    context = spark.sparkContext
    current = context.getCheckpointDir()
    if current:
        return current
    folder = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir")
    if not folder:
        if not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
        folder = tempfile.mkdtemp(prefix="cartolex-checkpoint-")
    context.setCheckpointDir(folder)
    return folder


def durable(df: DataFrame) -> DataFrame:
    """Materialise ``df`` once in the checkpoint folder; survives executor loss."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def spread(scan: DataFrame) -> DataFrame:
    """Give a scan at least one partition per core.

    A small table in one row group is read by a single task, which would then
    do all the text work after it. A scan of a full split or more for each core,
    as any large one is, is returned as it is. Results are equal either way.
    """
    spark = scan.sparkSession
    cores = spark.sparkContext.defaultParallelism
    bytes_of = spark.sparkContext._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes
    split = bytes_of(spark.conf.get("spark.sql.files.maxPartitionBytes"))
    return scan if _bytes(scan) >= cores * split else scan.repartition(cores)


def shares(scan: DataFrame, most: int) -> int:
    """Tasks for work on rows that grow far beyond their size in the file: one for each ``most`` bytes of the scan, and one per core."""
    return max(scan.sparkSession.sparkContext.defaultParallelism, -(-_bytes(scan) // most))


def _bytes(scan: DataFrame) -> int:
    return int(str(scan._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
