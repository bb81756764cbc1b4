"""Exact duplicates by recipes of content-defined chunks.

A text is cut where a rolling hash of its last 32 bytes says so; its recipe is the ordered list of the digests of its chunks.
Equal texts have equal recipes, so only texts whose recipe occurs again can be duplicates, and only their chunks move: once
for each task that has them, to be compared byte for byte. Where a digest turns out to stand for two contents, all texts get
longer digests with another salt. When each digest stands for one content, digests are identifiers, and equal recipes are
equal texts. All else is done on recipes: texts do not move again.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cartolex.llm.common import column, constants, flat, hash_bits, in_bits, pieces, ship, stored

CHUNK = 1 << 20
#: A chunk ends where a rolling hash has this many leading zeros, if that makes it no shorter and no longer than the bounds.
ZEROS, LEAST, MOST = 11, 512, 16_384
#: Bytes of a digest. At most 64.
ID_BYTES = 16
_WINDOW = 32
_GEAR = (constants(41, 256) >> np.uint64(32)).astype(np.uint32)

RECIPE = "doc_id long, text_sha256 string, recipe_key long, ids binary"
CHUNKS = "id binary, content binary"


def chunk_ends(data: np.ndarray, at: np.ndarray) -> list[list[int]]:
    """Where the chunks of each text end, as positions of the common buffer. An empty text has none."""
    ends = [[b] if b > a else [] for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
    long = np.flatnonzero(np.diff(at) > LEAST)
    if not len(long):
        return ends
    h = _GEAR[data]
    for width in (1, 2, 4, 8, 16):
        low = h[:-width] << np.uint32(width)
        h[width:] += low
    found = np.flatnonzero(h >> np.uint32(32 - ZEROS) == 0) + 1
    first = np.searchsorted(found, at[long] + _WINDOW)
    last = np.maximum(np.searchsorted(found, at[long + 1]), first)
    for row, a, b in zip(long.tolist(), first.tolist(), last.tolist(), strict=True):
        begin, end, cuts = int(at[row]), int(at[row + 1]), []
        for x in [*found[a:b].tolist(), end]:
            while x - begin > MOST:
                begin += MOST
                cuts.append(begin)
            if x - begin >= LEAST and x < end:
                cuts.append(x)
                begin = x
        ends[row] = [*cuts, end] if end > begin else cuts
    return ends


def _recipes(data: np.ndarray, at: np.ndarray, salt: int, width: int):
    """For each text its chunks, their digests one after another, and a 64-bit key of these."""
    raw, told = data.tobytes(), salt.to_bytes(8, "little")
    for begin, ends in zip(at[:-1].tolist(), chunk_ends(data, at), strict=True):
        chunks = [raw[a:b] for a, b in zip([begin, *ends], ends)]  # noqa: B905  one begin more than ends
        ids = [hashlib.blake2b(c, digest_size=width, salt=told).digest() for c in chunks]
        key = hashlib.blake2b(b"".join(ids), digest_size=8).digest()
        yield chunks, ids, int.from_bytes(key, "little", signed=True)


def _recipe(salt: int, width: int):
    def task(batches):
        for part in pieces(batches, "text", CHUNK):
            found = [(key, b"".join(ids)) for _, ids, key in _recipes(*flat(part.column(2)), salt, width)]
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array([k for k, _ in found], pa.int64()), pa.array([i for _, i in found], pa.binary())], ["doc_id", "text_sha256", "recipe_key", "ids"])

    return task


def _contents(salt: int, width: int, wanted):
    """Chunks of the texts whose key has its bit, equal ones of a batch once."""

    def task(batches):
        for part in pieces(batches, "text", CHUNK):
            found = list(_recipes(*flat(part.column(0)), salt, width))
            meets = in_bits(wanted.value, np.array([key for *_, key in found], np.int64))
            chunks = {pair for (own, ids, _), ok in zip(found, meets.tolist(), strict=True) if ok for pair in zip(ids, own, strict=True)}
            yield pa.RecordBatch.from_arrays([pa.array([i for i, _ in chunks], pa.binary()), pa.array([c for _, c in chunks], pa.binary())], ["id", "content"])

    return task


def duplicate_groups(documents: DataFrame, normalise=None, id_bytes: int = ID_BYTES, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Groups of documents whose texts are equal after ``normalise`` (a function of a string column; None changes nothing).

    Returns doc_id, keep_id (largest id of the group), group_size (rows), kept (doc_id = keep_id) and text_sha256 (normalised
    text in UTF-8), a row for each row of the input. Null counts as empty, and empty texts are equal. Rows that repeat both id
    and text are counted each, and share one verdict. A row without an id goes if its group has one with; a group without any
    id has a null keep_id and stays. Other columns are not read.
    """
    spark = documents.sparkSession
    ship(spark)
    value: Column = F.coalesce(F.col(f"`{text}`").cast("string"), F.lit(""))
    if normalise is not None:
        value = F.coalesce(normalise(value), F.lit(""))
    docs = documents.select(column(documents, doc_id, "doc_id", "bigint"), value.alias("text"))
    hashed = docs.select("doc_id", F.sha2(F.col("text").cast("binary"), 256).alias("text_sha256"), "text")
    # A group may hold most rows: its rows are counted in slices first, and rows find their group by slice again.
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    own = F.pmod(F.xxhash64("doc_id"), F.lit(parts)).cast("int")
    salt, width = 0, id_bytes
    while True:
        recipes = stored(hashed.mapInArrow(_recipe(salt, width), RECIPE), "recipes").withColumn("slice", own)
        slices = stored(recipes.groupBy("recipe_key", "ids", "slice").agg(F.count("*").alias("n"), F.max("doc_id").alias("most")), "recipe-slices")
        groups = slices.groupBy("recipe_key", "ids").agg(F.sum("n").alias("group_size"), F.max("most").alias("keep_id")).filter("group_size > 1")
        wanted = spark.sparkContext.broadcast(hash_bits(groups.select("recipe_key")))
        contents = docs.select("text").mapInArrow(_contents(salt, width, wanted), CHUNKS).groupBy("id", "content").agg(F.count("*").alias("n"))
        if contents.groupBy("id").agg(F.count("*").alias("n")).filter("n > 1").isEmpty():
            break
        salt, width = salt + 1, min(64, width + 1)
    told = slices.select("recipe_key", "ids", "slice").join(groups, ["recipe_key", "ids"])
    out = recipes.join(told, ["recipe_key", "ids", "slice"], "left")
    alone = F.col("group_size").isNull()
    keep = F.when(alone, F.col("doc_id")).otherwise(F.col("keep_id"))
    return out.select("doc_id", keep.alias("keep_id"), F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"), F.col("doc_id").eqNullSafe(keep).alias("kept"), "text_sha256")


def drop_duplicates(documents: DataFrame, normalise=None, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The documents without the rows that ``duplicate_groups`` does not keep; columns stay as they are.

    Rows are told apart by id and text: rows without an id stay only where none of their group has one.
    """
    value = F.coalesce(F.col(f"`{text}`").cast("string"), F.lit(""))
    value = value if normalise is None else F.coalesce(normalise(value), F.lit(""))
    gone = duplicate_groups(documents, normalise, ID_BYTES, doc_id, text).filter(~F.col("kept")).select("doc_id", "text_sha256").distinct()
    gone = gone.select(F.col("doc_id").alias("_gone_id"), F.col("text_sha256").alias("_gone_text"))
    same = F.col(f"`{doc_id}`").cast("long").eqNullSafe(F.col("_gone_id")) & (F.sha2(value.cast("binary"), 256) == F.col("_gone_text"))
    return documents.join(gone.hint("shuffle_hash"), same, "left_anti")
