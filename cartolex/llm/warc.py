"""Deterministic sharded WARC archives, and the way back.

Records are sorted by id and cut into shards at ids that depend on the data alone (quantiles of a sample by hash), so the same
rows always give the same files. A task writes the records of a shard one by one, each a gzip member of its own, and starts
a new file when the compressed size passes a limit. Files are written under temporary names of the attempt; the manifest of
the attempts that Spark took is stored, its files are renamed, and the manifest beside them is written last: readers follow
it alone, so a lost executor or a run that broke off leaves nothing that can be read.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote

import numpy as np
import pandas as pd
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cartolex.llm.common import ship, stored

#: Bytes of payload of a shard, about; sampled ids for each shard; compressed bytes of a file.
SHARD_BYTES, SAMPLES, FILE_BYTES = 128 << 20, 16, 256 << 20
#: Every record has the same date: archives of the same rows are the same bytes.
DATE = "2000-01-01T00:00:00Z"
WRITTEN = "name string, temporary string, shard int, records long, bytes long, sha256 string"
RECORD = "record_key long, record_type string, uri string, payload_bytes long, payload_digest string, refers_to long, payload binary"
IDENTICAL = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def digest_of(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def _id(key, digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'record:{key}:{digest}')}>"


def _record(kind: str, headers: list[tuple[str, str]], block: bytes) -> bytes:
    """One record as a gzip member; headers are made anew from what is written."""
    lines = [("WARC-Type", kind), ("WARC-Date", DATE), *headers, ("WARC-Block-Digest", f"sha1:{digest_of(block)}"), ("Content-Length", str(len(block)))]
    head = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in lines) + "\r\n"
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    return packer.compress(head.encode() + block + b"\r\n\r\n") + packer.flush()


def _page(key, uri: str | None, payload: bytes, keeper) -> bytes:
    digest = digest_of(payload)
    headers = [("WARC-Record-ID", _id(key, digest)), ("WARC-Payload-Digest", f"sha1:{digest}"), ("X-Payload-Length", str(len(payload)))]
    if key is not None:
        headers.append(("X-Record-Key", str(key)))
    if uri is not None:
        headers.append(("WARC-Target-URI", quote(uri, safe="".join(map(chr, range(33, 127))))))
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    kind = "response"
    if keeper is not None:
        kind, payload = "revisit", b""
        headers += [("WARC-Profile", IDENTICAL), ("WARC-Refers-To", _id(keeper, digest)), ("X-Refers-To-Key", str(keeper))]
    headers.append(("Content-Type", "application/http; msgtype=response"))
    return _record(kind, headers, http + payload)


def _filesystem(folder: str):
    return fs.FileSystem.from_uri(folder) if "://" in folder or folder.startswith("file:") else (fs.LocalFileSystem(), folder)


def _write(folder: str, file_bytes: int):
    """Rows in order of shard and id, each revisit's note before its record, to files and their manifest."""

    def task(batches):
        place, path = _filesystem(folder)
        attempt = f"{path}/_temporary/{uuid.uuid4().hex}"
        out, state, rows = None, {}, []

        def close():
            nonlocal out
            if out is not None:
                out.close()
                rows.append((state["name"], f"{attempt}/{state['name']}", state["shard"], state["records"], state["bytes"], state["sha"].hexdigest()))
                out = None

        def begin(shard: int, number: int):
            nonlocal out
            close()
            name = f"shard-{shard:07d}-{number:05d}.warc.gz"
            place.create_dir(attempt, recursive=True)
            # The member is gzip already: no compression by the name's ending.
            out = place.open_output_stream(f"{attempt}/{name}", compression=None)
            state.update(name=name, shard=shard, number=number, records=0, bytes=0, sha=hashlib.sha256())
            put(_record("warcinfo", [("WARC-Record-ID", _id(name, "")), ("WARC-Filename", name), ("Content-Type", "application/warc-fields")], b"format: WARC File Format 1.1\r\n"))

        def put(member: bytes):
            out.write(member)
            state["bytes"] += len(member)
            state["sha"].update(member)

        note, keeper, shard = None, None, None
        for batch in batches:
            # One row at a time as Python objects, so that a batch of long pages is not held twice.
            for i in range(batch.num_rows):
                at, key, digest, kind, uri, payload, other = (batch.column(c)[i].as_py() for c in range(7))
                if kind == 0:
                    note, keeper = (key, digest), other
                    continue
                member = _page(key, uri, payload or b"", keeper if (key, digest) == note else None)
                if at != shard:
                    shard = at
                    begin(at, 0)
                elif state["bytes"] + len(member) > file_bytes and state["records"]:
                    begin(at, state["number"] + 1)
                put(member)
                state["records"] += 1
        close()
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate((pa.string(), pa.string(), pa.int32(), pa.int64(), pa.int64(), pa.string()))], [x.split()[0] for x in WRITTEN.split(", ")])

    return task


def _publish(folder: str):
    """Rename the files of the manifest. Done again after a loss, what has its name already is left alone."""

    def task(batches):
        place, path = _filesystem(folder)
        for batch in batches:
            for name, temporary, size in zip(*(batch.column(c).to_pylist() for c in ("name", "temporary", "bytes")), strict=True):
                there, old = place.get_file_info([f"{path}/{name}", temporary])
                if old.type == fs.FileType.File:
                    place.move(temporary, f"{path}/{name}")
                elif there.type != fs.FileType.File or there.size != size:
                    raise FileNotFoundError(f"{name} is neither written nor published")
            yield batch

    return task


def _bounds(rows: DataFrame, shards: int) -> list[int]:
    """Ids at which shards begin, from ids that a hash picks: the same for the same rows."""
    if shards < 2:
        return []
    n = rows.count()
    every = max(1, n // (shards * SAMPLES))
    ids = sorted(r[0] for r in rows.filter(F.col("record_key").isNotNull() & (F.pmod(F.xxhash64("record_key"), F.lit(every)) == 0)).select("record_key").distinct().collect())
    return sorted({ids[len(ids) * k // shards] for k in range(1, shards)}) if ids else []


def write_warc(pages: DataFrame, folder: str, key: str = "page_id", uri: str = "url", payload: str = "html", least: int = 0, shard_bytes: int = SHARD_BYTES, file_bytes: int = FILE_BYTES) -> None:
    """Write a record for each row into ``folder``, which all executors reach.

    The payload is the UTF-8 of ``payload`` (null: empty). Of records with equal payloads of at least ``least`` bytes that
    with the largest id is a response and the others revisit it; shorter ones are all responses. Rows that share id and
    payload are all what that id is. A row without an id is a response that nothing revisits unless it is alone with its
    payload. A null uri has no header; characters that a header can't hold are percent-encoded. Other columns are not read.
    """
    spark = pages.sparkSession
    ship(spark)
    body = F.coalesce(F.col(f"`{payload}`").cast("string"), F.lit("")).cast("binary")
    rows = pages.select(F.col(f"`{key}`").cast("long").alias("record_key"), F.col(f"`{uri}`").cast("string").alias("uri"), body.alias("payload"))
    rows = rows.withColumn("digest", F.sha1("payload"))
    slim = stored(rows.select("record_key", "digest", F.octet_length("payload").cast("long").alias("size")), "warc-ids")
    keepers = slim.filter(F.col("size") >= least).groupBy("digest").agg(F.max("record_key").alias("keeper"))
    notes = slim.filter(F.col("size") >= least).join(keepers, "digest").filter("record_key < keeper").select("record_key", "digest", "keeper").distinct()
    total = slim.agg(F.sum("size")).first()[0] or 0
    bounds = np.array(_bounds(slim, -(-total // shard_bytes)), np.int64)
    parts = len(bounds) + 1

    @F.pandas_udf("int")
    def shard_of(ids):
        return pd.Series(np.searchsorted(bounds, ids.to_numpy(np.int64), "right").astype(np.int32))

    spread = F.pmod(F.xxhash64("digest"), F.lit(parts)).cast("int")
    full = rows.select("record_key", "digest", F.lit(1).alias("kind"), "uri", "payload", F.lit(None).cast("long").alias("keeper"))
    full = full.unionByName(notes.select("record_key", "digest", F.lit(0).alias("kind"), F.lit(None).cast("string").alias("uri"), F.lit(None).cast("binary").alias("payload"), "keeper"))
    shard = F.when(F.col("record_key").isNull(), spread).otherwise(shard_of(F.coalesce("record_key", F.lit(0)))) if len(bounds) else F.lit(0)
    full = full.withColumn("shard", shard).select("shard", "record_key", "digest", "kind", "uri", "payload", "keeper")
    sorted_rows = full.repartitionById(parts, F.col("shard")).sortWithinPartitions("shard", "record_key", "digest", "kind")
    manifest = stored(sorted_rows.mapInArrow(_write(folder, file_bytes), WRITTEN), "warc-manifest")
    manifest.repartition(max(1, min(parts, 200)), "name").mapInArrow(_publish(folder), WRITTEN).write.mode("overwrite").parquet(f"{folder}/manifest")
    place, path = _filesystem(folder)
    if place.get_file_info(f"{path}/_temporary").type == fs.FileType.Directory:
        place.delete_dir(f"{path}/_temporary")


def members(stream, size: int = 1 << 20) -> Iterator[bytes]:
    """The gzip members of a stream, one at a time."""
    rest = b""
    while True:
        unpacker, parts = zlib.decompressobj(31), []
        while not unpacker.eof:
            if not rest:
                rest = stream.read(size)
                if not rest:
                    if parts:
                        raise EOFError("a record is cut off")
                    return
            parts.append(unpacker.decompress(rest))
            rest = unpacker.unused_data
        yield b"".join(parts)


_HEADER = re.compile(rb"([A-Za-z-]+): ([^\r\n]*)\r\n")


def parse(member: bytes) -> tuple[dict[str, str], bytes]:
    """Headers and block of a record; a wrong length or digest is an error."""
    head, _, rest = member.partition(b"\r\n\r\n")
    headers = {k.decode(): v.decode() for k, v in _HEADER.findall(head + b"\r\n")}
    block = rest[: int(headers["Content-Length"])]
    if rest[len(block) :] != b"\r\n\r\n" or headers["WARC-Block-Digest"] != f"sha1:{digest_of(block)}":
        raise ValueError(f"record {headers.get('WARC-Record-ID')} is damaged")
    return headers, block


def _read(folder: str, with_payload: bool):
    def task(batches):
        place, path = _filesystem(folder)
        names = [x.split()[0] for x in RECORD.split(", ")]
        kinds = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.binary()]
        held, size = [], 0

        def flush():
            return pa.RecordBatch.from_arrays([pa.array([r[i] for r in held], k) for i, k in enumerate(kinds)], names)

        for batch in batches:
            for name in batch.column(0).to_pylist():
                with place.open_input_stream(f"{path}/{name}", compression=None) as stream:
                    for member in members(stream):
                        headers, block = parse(member)
                        kind = headers["WARC-Type"]
                        if kind == "warcinfo":
                            continue
                        payload = block.partition(b"\r\n\r\n")[2]
                        digest, length = headers["WARC-Payload-Digest"].removeprefix("sha1:"), int(headers["X-Payload-Length"])
                        if kind == "response" and (digest_of(payload) != digest or len(payload) != length):
                            raise ValueError(f"payload of {headers['WARC-Record-ID']} is damaged")
                        key, other = headers.get("X-Record-Key"), headers.get("X-Refers-To-Key")
                        held.append((key and int(key), kind, headers.get("WARC-Target-URI"), length, digest, other and int(other), payload if with_payload and kind == "response" else None))
                        size += len(payload) if with_payload else 100
                        if size > 4 << 20:
                            yield flush()
                            held, size = [], 0
        if held:
            yield flush()

    return task


def read_warc(spark: SparkSession, folder: str, payload: bool = True) -> DataFrame:
    """The records that the manifest of a folder names. Revisits have length and digest of the full payload, but no payload.

    Every response is checked against its digests. ``payload=False`` leaves the payloads out.
    """
    ship(spark)
    names = spark.read.parquet(f"{folder}/manifest").select("name", "bytes")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return names.repartition(parts, "name").select("name").mapInArrow(_read(folder, payload), RECORD)
