"""Archives: every row comes back, the same rows give the same files, broken attempts stay unseen."""

import base64
import gzip
import hashlib
import os

import pytest

from cartolex.llm.warc import members, parse, read_warc, write_warc

SCHEMA = "page_id long, url string, html string, payload string, digest string"


def rows():
    out = [(i, f"http://h.example/{i % 7}?q=é {i}", f"<p>page {i % 50}</p>" + "é" * (i % 13), "x", "y") for i in range(300)]
    out += [(1000, None, None, None, None), (1001, "u", "", "x", "y"), (1002, "a\r\nX: b", "z" * 500_000, "x", "y"), (1003, "u", "\r\n\r\nWARC/1.1", "x", "y")]
    out += [(1004, "u", "twice", "x", "y"), (1004, "u", "twice", "x", "y"), (1004, "u", "other", "x", "y"), (1, "u", "twice", "x", "y"), (None, "u", "no id", "x", "y"), (None, "u", "twice", "x", "y")]
    return out


def expected(data, least):
    raw = [(k, (h or "").encode()) for k, _, h, *_ in data]
    keeper = {}
    for k, p in raw:
        if k is not None and len(p) >= least:
            keeper[p] = max(k, keeper.get(p, k))
    out = []
    for k, p in raw:
        to = keeper.get(p) if k is not None else None
        to = to if to is not None and k < to else None
        out.append((k, "response" if to is None else "revisit", len(p), base64.b32encode(hashlib.sha1(p).digest()).decode(), to))
    return sorted(out, key=repr)


def plain(df):
    return sorted(((r.record_key, r.record_type, r.payload_bytes, r.payload_digest, r.refers_to) for r in df.collect()), key=repr)


@pytest.mark.parametrize(("least", "shard_bytes", "file_bytes"), [(0, 1 << 30, 1 << 30), (10, 2000, 3000), (0, 100_000, 500)])
def test_round_trip(spark, tmp_path, least, shard_bytes, file_bytes):
    data = rows()
    folder = str(tmp_path / "warc")
    write_warc(spark.createDataFrame(data, SCHEMA).repartition(5), folder, least=least, shard_bytes=shard_bytes, file_bytes=file_bytes)
    back = read_warc(spark, folder)
    assert plain(back) == expected(data, least)
    payload = {(r.record_key, bytes(r.payload)) for r in back.filter("record_type = 'response'").collect()}
    assert payload <= {(k, (h or "").encode()) for k, _, h, *_ in data}
    assert not os.path.exists(f"{folder}/_temporary")


def test_same_rows_same_files(spark, tmp_path):
    found = []
    for n, order in ((2, "page_id"), (7, "html")):
        folder = str(tmp_path / f"warc{n}")
        write_warc(spark.createDataFrame(rows(), SCHEMA).orderBy(order).repartition(n), folder, shard_bytes=3000, file_bytes=2000)
        found.append({f: open(f"{folder}/{f}", "rb").read() for f in os.listdir(folder) if f.endswith(".gz")})
    assert len(found[0]) > 5 and found[0] == found[1]


def test_files_are_gzip_and_sorted(spark, tmp_path):
    folder = str(tmp_path / "warc")
    write_warc(spark.createDataFrame(rows(), SCHEMA), folder, shard_bytes=3000)
    keys = []
    for f in sorted(x for x in os.listdir(folder) if x.endswith(".gz")):
        assert gzip.open(f"{folder}/{f}").read().startswith(b"WARC/1.1\r\nWARC-Type: warcinfo")
        with open(f"{folder}/{f}", "rb") as stream:
            heads = [parse(m)[0] for m in members(stream)]
        own = [int(h["X-Record-Key"]) for h in heads if "X-Record-Key" in h]
        assert own == sorted(own)
        keys += own
    assert keys == sorted(keys)


def test_what_the_manifest_lacks_is_not_read(spark, tmp_path):
    folder = str(tmp_path / "warc")
    write_warc(spark.createDataFrame(rows(), SCHEMA), folder)
    with open(f"{folder}/shard-9999999-00000.warc.gz", "wb") as f:
        f.write(b"half a file")
    assert plain(read_warc(spark, folder)) == expected(rows(), 0)


def test_damage_is_noticed(spark, tmp_path):
    with pytest.raises(ValueError, match="damaged"):
        parse(b"WARC/1.1\r\nWARC-Block-Digest: sha1:A\r\nContent-Length: 1\r\n\r\nx\r\n\r\n")


def test_empty_table(spark, tmp_path):
    folder = str(tmp_path / "warc")
    write_warc(spark.createDataFrame([], SCHEMA), folder)
    assert read_warc(spark, folder).collect() == []
