"""What the operators share: shipping code, the shared folder, Arrow text buffers, 64-bit hashing."""

from __future__ import annotations

import ctypes
import os
import tempfile
import uuid
import zipfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

FREE_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: Rows of one Arrow batch at most: a batch of long texts has to fit beside a Python worker.
BATCH_ROWS = 2000

_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Give every executor this package, once per application, and keep Arrow batches small.

    Tasks import the package from the file that Spark itself distributes, so executors need no copy of the repository.
    """
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) > BATCH_ROWS:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    package = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    top = os.path.dirname(package)
    target = os.path.join(tempfile.mkdtemp(prefix="cartolex-ship-"), "cartolex_tasks.zip")
    with zipfile.ZipFile(target, "w") as z:
        for folder, _, files in os.walk(package):
            for f in sorted(files):
                if f.endswith(".py"):
                    z.write(os.path.join(folder, f), os.path.relpath(os.path.join(folder, f), top))
    spark.sparkContext.addPyFile(target)
    _shipped.add(app)


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder of one run below ``spark.checkpoint.dir``, which every executor reaches.

    Where the setting is missing (tests on a local master) a folder of this machine is named and kept for the session.
    """
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that every executor reaches")
        base = tempfile.mkdtemp(prefix="cartolex-shared-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once as Parquet in the shared folder and read it back: lineage ends there."""
    spark = df.sparkSession
    folder = shared_folder(spark, name)
    # The written table replaces the shuffles it came from, so their files can go at once.
    before = spark.conf.get(FREE_SHUFFLES)
    spark.conf.set(FREE_SHUFFLES, "true")
    try:
        df.write.option("compression", "zstd").parquet(folder)
    finally:
        spark.conf.set(FREE_SHUFFLES, before)
    return spark.read.schema(df.schema).parquet(folder)


def column(df: DataFrame, name: str, to: str, kind: str) -> Column:
    """A column under another name and type. What has both already is left bare: equal exchanges are then seen to be equal."""
    if name == to and dict(df.dtypes).get(name) == kind:
        return F.col(name)
    return F.col(f"`{name}`").cast(kind).alias(to)


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def buckets_of(spark: SparkSession) -> int:
    """Buckets for keyed work: a few for each shuffle partition, which the user sizes by the data."""
    return 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))


# ---- Arrow text


def flat(column) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of a string or binary column, one after another, and where each row begins (null: empty)."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary())
    if column.null_count:
        column = column.fill_null(b"")
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    held = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None and len(at) else np.zeros(0, np.uint8)
    return held, at - at[0]


def pieces(batches, column: str, limit: int) -> Iterator[pa.RecordBatch]:
    """The batches cut so that ``column`` has about ``limit`` bytes in each; a longer text comes alone."""
    for batch in batches:
        if not batch.num_rows:
            continue
        _, at = flat(batch.column(batch.schema.get_field_index(column)))
        start = 0
        while start < batch.num_rows:
            stop = max(start + 1, int(np.searchsorted(at, at[start] + limit, "right")) - 1)
            yield batch.slice(start, stop - start)
            start = stop


def longs(column) -> np.ndarray:
    """A long column without nulls as numpy (null: 0)."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.cast(pa.int64()).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)


def valid(column) -> np.ndarray:
    return column.is_valid().to_numpy(zero_copy_only=False)


# ---- 64-bit hashing, vectorised

U = np.uint64


def constants(seed: int, n: int) -> np.ndarray:
    """n odd 64-bit numbers by a fixed rule (splitmix)."""
    x = (np.arange(1, n + 1, dtype=U) + U(seed * 1000003)) * U(0x9E3779B97F4A7C15)
    return mix(x) | U(1)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = x ^ (x >> U(33))
    x *= U(0xFF51AFD7ED558CCD)
    x ^= x >> U(33)
    x *= U(0xC4CEB9FE1A85EC53)
    x ^= x >> U(33)
    return x


def powers(base: int, n: int) -> np.ndarray:
    """base**0 ... base**(n-1) modulo 2**64."""
    out = np.full(max(n, 1), U(base))
    out[0] = 1
    return np.multiply.accumulate(out)[:n]


#: For prefix sums: an odd base and its inverse modulo 2**64.
BASE = 0x9E3779B97F4A7C15
INVERSE = pow(BASE, -1, 1 << 64)


class Spans:
    """Hashes of byte ranges of one buffer from prefix sums: equal ranges hash equally wherever they lie."""

    def __init__(self, data: np.ndarray, codes: np.ndarray, shared: dict):
        n = len(data)
        if shared.get("n", 0) <= n:
            shared.update(n=n + 1, up=powers(BASE, n + 1), down=powers(INVERSE, n + 1))
        self.down = shared["down"]
        self.sums = np.zeros(n + 1, U)
        np.cumsum(codes[data] * shared["up"][:n], out=self.sums[1:])

    def of(self, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self.sums[end] - self.sums[begin]) * self.down[begin])


# ---- memory of workers


def lean(task):
    """A task for mapInArrow that gives its memory back when it ends: Spark uses a worker again, also for other stages."""

    def run(batches):
        try:
            yield from task(batches)
        finally:
            pa.default_memory_pool().release_unused()
            try:
                ctypes.CDLL(None).malloc_trim(0)
            except (AttributeError, OSError):
                pass  # a C library without it

    return run


# ---- packed arrays


def pack(values: np.ndarray) -> bytes:
    """64-bit numbers as zstd of their byte planes, sorted ones as differences: bytes that are all alike cost nothing."""
    values = values.view(np.uint64)
    rises = bool((values[1:] >= values[:-1]).all())
    if rises:
        values = np.diff(values, prepend=np.uint64(0))
    planes = np.ascontiguousarray(values.view(np.uint8).reshape(-1, 8).T)
    return bytes([rises]) + pa.compress(planes.tobytes(), codec="zstd", asbytes=True)


def unpack(blob: bytes, n: int, kind=np.uint64) -> np.ndarray:
    raw = pa.decompress(blob[1:], decompressed_size=8 * n, codec="zstd", asbytes=True)
    values = np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(8, n).T).view(np.uint64).reshape(-1)
    return (np.cumsum(values, dtype=np.uint64) if blob[0] else values).view(kind)


# ---- a set of hashes in bounded memory

#: Bits of a hash table that a task holds: 8 MB, whatever the data. A fuller table lets more through, and loses nothing.
TABLE_BITS = 1 << 26
_BLOCK = 1 << 15


def hash_bits(hashes: DataFrame) -> np.ndarray:
    """One bit for each value of the only column (long), as bytes. What is in the set has its bit; few others have."""
    name = hashes.columns[0]
    place = F.col(name).bitwiseAND(F.lit(TABLE_BITS - 1))
    blocks = hashes.select(place.alias("p")).groupBy(F.shiftright("p", 15).cast("int").alias("block"))
    bits = np.zeros(TABLE_BITS // 8, np.uint8)
    for row in blocks.agg(F.bitmap_construct_agg(F.col("p").bitwiseAND(F.lit(_BLOCK - 1))).alias("bits")).collect():
        bits[row.block * (_BLOCK // 8) :][: _BLOCK // 8] = np.frombuffer(row.bits, np.uint8)
    return bits


def in_bits(bits: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    place = hashes.view(np.uint64) & U(TABLE_BITS - 1)
    return (bits[(place >> U(3)).astype(np.int64)] >> (place & U(7)).astype(np.uint8)) & 1 == 1
