"""Exact removal of long repeated byte strings with a logarithmic family of sparse suffix arrays.

Every string of ``length`` bytes holds one anchor: the smallest hash among its ``GRAM``-byte grams. Suffixes are indexed
only where the anchor changes, so the index has about one entry for 16 bytes of text. An entry stands for a run of
neighbouring start positions with one anchor (a *block*), its content given by fingerprints of the first and last string.

1. A task turns each batch of texts into a suffix array: entries ordered by content fingerprint, equal contents beside
   each other. Of equal contents the smallest document stays; the others are repeats at once. So a passage that a third
   of all documents share costs one entry for each batch, not for each document.
2. Entries are dealt out by anchor. In a bucket, each new array is merge-scanned against the existing levels; of two
   equal contents the larger document is a repeat. What is new becomes a level, and levels of like size merge.
3. Blocks that share an anchor, but not their whole content (the ends of repeated passages), go through the same steps
   again with one entry for each start position.
4. The repeats come back to their documents, which lose every covered byte.

Fingerprints have 48 bits beside the 64 bits of the anchor, and 64 beside 16 of the anchor in the second pass.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cartolex.llm.common import U, buckets_of, column, constants, flat, longs, mix, pack, pieces, ship, stored, unpack, valid

GRAM = 20
#: Start positions of one block at most, so that the first and last string cover it.
BLOCK = 32
#: An anchor with more different blocks than this in one batch is dealt out by content instead.
HOT = 32
#: Bytes of text hashed at a time, and taken into one suffix array.
CHUNK, BATCH = 1 << 20, 16 << 20
REPEAT, CONTESTED = 1, 2
_C = constants(7, 16)
_LOW48, _LOW16 = U((1 << 48) - 1), U((1 << 16) - 1)
RUNS = "bucket int, n int, anchors binary, contents binary, docs binary, state int"
FOUND = "doc_id long, content long, state int"


class Hashes:
    """Anchors and content fingerprints of the strings of ``length`` bytes in a buffer of texts."""

    def __init__(self, data: np.ndarray, at: np.ndarray, length: int):
        n = len(data)
        self.length, self.n = length, n
        padded = np.zeros(n + length + 24, np.uint8)
        padded[:n] = data
        words = np.empty(n + length + 8, U)
        for i in range(8):
            part = words[i::8]
            part[:] = padded[i : i + 8 * len(part)].view("<u8")
        self.words = mix(words)
        w = self.words
        grams = w[:n] * _C[0] + w[8 : n + 8] * _C[1] + w[GRAM - 8 : n + GRAM - 8] * _C[2]
        grams ^= grams >> U(31)
        grams *= _C[3]
        grams ^= grams >> U(29)
        # The smallest of the grams that begin in a string: windows of doubling width.
        wide = length - GRAM + 1
        least, width = grams, 1
        while 2 * width <= wide:
            least = np.minimum(least[:-width], least[width:]) if len(least) > width else least[:0]
            width *= 2
        if width < wide:
            step = wide - width
            least = np.minimum(least[:-step], least[step:]) if len(least) > step else least[:0]
        self.least = least
        # Start positions whose string lies in one text.
        rows = np.repeat(np.arange(len(at) - 1), np.diff(at))
        last = at[1:] - length
        self.rows = rows
        ok = np.arange(len(least)) <= last[rows[: len(least)]] if len(least) else np.zeros(0, bool)
        self.starts = np.flatnonzero(ok)

    def content(self, p: np.ndarray) -> np.ndarray:
        """Fingerprint of the string of ``length`` bytes at each of the positions."""
        h = np.zeros(len(p), U)
        steps = [*range(0, self.length - 8, 8), self.length - 8]
        for i, step in enumerate(steps):
            h += self.words[p + step] * _C[4 + i % 10]
            h = (h << U(7)) | (h >> U(57))
        return mix(h)

    def blocks(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Row, first and last start position, anchor and content of each block."""
        p = self.starts
        if not len(p):
            none = np.zeros(0, np.int64)
            return none, none, none, none.astype(U), none.astype(U)
        rows, low = self.rows[p], self.least[p]
        new = np.ones(len(p), bool)
        new[1:] = (rows[1:] != rows[:-1]) | (low[1:] != low[:-1])
        begin = np.flatnonzero(new)
        size = np.diff(np.append(begin, len(p)))
        parts = -(-size // BLOCK)
        if (parts > 1).any():
            inner = np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts)
            begin = np.repeat(begin, parts) + inner * BLOCK
            size = np.diff(np.append(begin, len(p)))
        first, last = p[begin], p[begin + size - 1]
        content = mix(self.content(first) * _C[14] + self.content(last) * _C[15] + (last - first).astype(U)) & _LOW48
        return rows[begin], first, last, low[begin], content


def _first_of(anchors, contents, docs):
    """Entries in content order; whether each is the first of its content, the smallest document first."""
    order = np.lexsort((docs, anchors, contents))
    anchors, contents, docs = anchors[order], contents[order], docs[order]
    new = np.ones(len(docs), bool)
    new[1:] = (contents[1:] != contents[:-1]) | (anchors[1:] != anchors[:-1])
    return anchors, contents, docs, new


def _array_of(anchors, contents, docs, buckets: int, by_content: bool):
    """Suffix array of a batch: rows of RUNS, one for each bucket, and one with the repeats inside the batch."""
    anchors, contents, docs, new = _first_of(anchors, contents, docs)
    group = np.cumsum(new) - 1
    heads = np.flatnonzero(new)
    late = docs > docs[heads][group] if len(docs) else new
    if late.any():
        # These go through as they are, in any bucket.
        yield from _run(int(docs[late][0] % buckets), anchors[late], contents[late], docs[late], REPEAT)
    anchors, contents, docs = anchors[heads], contents[heads], docs[heads]
    if by_content:
        yield from _deal(contents, anchors, contents, docs, 0, buckets)
        return
    order = np.argsort(anchors, kind="stable")
    anchors, contents, docs = anchors[order], contents[order], docs[order]
    starts = np.flatnonzero(np.concatenate([[True], anchors[1:] != anchors[:-1]])) if len(anchors) else np.zeros(0, int)
    sizes = np.diff(np.append(starts, len(anchors)))
    if (sizes > HOT).any():
        hot = np.repeat(sizes > HOT, sizes)
        # Two entries stay with the anchor: they tell its bucket that the anchor is contested.
        within = np.arange(len(anchors)) - np.repeat(starts, sizes)
        yield from _deal(contents[hot], anchors[hot], contents[hot], docs[hot], CONTESTED, buckets)
        keep = ~hot | (within < 2)
        anchors, contents, docs = anchors[keep], contents[keep], docs[keep]
    yield from _deal(anchors, anchors, contents, docs, 0, buckets)


def _deal(by, anchors, contents, docs, state: int, buckets: int):
    # Anchors are minima, so most are small: buckets go by a mix of them.
    bucket = ((mix(by * _C[1]) >> U(32)) * U(buckets) >> U(32)).astype(np.int64)
    # Within a bucket in the order of what it is dealt by: sorted numbers pack well.
    order = np.lexsort((by, bucket))
    bucket = bucket[order]
    cuts = np.append(np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]])), len(bucket)) if len(bucket) else [0]
    for a, b in zip(cuts[:-1], cuts[1:], strict=True):
        o = order[a:b]
        yield from _run(int(bucket[a]), anchors[o], contents[o], docs[o], state)


def _run(bucket, anchors, contents, docs, state):
    yield bucket, len(docs), pack(anchors), pack(contents), pack(docs.astype(np.int64)), state


def _rows(rows: Iterator[tuple], names: list[str], kinds: list[pa.DataType], size: int = 256) -> Iterator[pa.RecordBatch]:
    held = []
    for row in rows:
        held.append(row)
        if len(held) == size:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*held, strict=True), kinds, strict=True)], names)
            held = []
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*held, strict=True), kinds, strict=True)], names)


RUN_NAMES = ["bucket", "n", "anchors", "contents", "docs", "state"]
RUN_KINDS = [pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.binary(), pa.int32()]


def _index(length: int, buckets: int):
    """Texts to suffix arrays of their blocks."""

    def task(batches):
        def rows():
            held, size = [], 0
            for part in pieces(batches, "text", CHUNK):
                ids = longs(part.column(0))
                data, at = flat(part.column(1))
                row, _, _, anchors, contents = Hashes(data, at, length).blocks()
                held.append((anchors, contents, ids[row]))
                size += len(data)
                if size >= BATCH:
                    yield from _array_of(*map(np.concatenate, zip(*held, strict=True)), buckets, False)
                    held, size = [], 0
            if held:
                yield from _array_of(*map(np.concatenate, zip(*held, strict=True)), buckets, False)

        yield from _rows(rows(), RUN_NAMES, RUN_KINDS)

    return task


def _index_contested(length: int, buckets: int):
    """Texts with the contents of their contested blocks to suffix arrays of every start position in these."""

    def task(batches):
        def rows():
            held, size = [], 0
            for part in pieces(batches, "text", CHUNK):
                part = part.filter(part.column(2).is_valid())
                if not part.num_rows:
                    continue
                ids = longs(part.column(0))
                data, at = flat(part.column(1))
                hashes = Hashes(data, at, length)
                row, p, anchors = _positions(hashes, _members(part.column(2)))
                held.append((anchors & _LOW16, hashes.content(p), ids[row]))
                size += 24 * len(p)
                if size >= BATCH:
                    yield from _array_of(*map(np.concatenate, zip(*held, strict=True)), buckets, True)
                    held, size = [], 0
            if held:
                yield from _array_of(*map(np.concatenate, zip(*held, strict=True)), buckets, True)

        yield from _rows(rows(), RUN_NAMES, RUN_KINDS)

    return task


def _members(column) -> np.ndarray:
    """Row and value of a list column as one number each."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    values = column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).view(U)
    sizes = column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    return _tagged(np.repeat(np.arange(len(column)), sizes), values)


def _tagged(rows: np.ndarray, values: np.ndarray) -> np.ndarray:
    return mix(values + rows.astype(U) * _C[5])


def _positions(hashes: Hashes, wanted: np.ndarray):
    """Row, position and anchor of every start position in the blocks with the wanted contents."""
    row, first, last, anchors, contents = hashes.blocks()
    chosen = np.isin(_tagged(row, contents), wanted)
    row, first, last, anchors = row[chosen], first[chosen], last[chosen], anchors[chosen]
    size = last - first + 1
    p = np.repeat(first, size) + np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
    return np.repeat(row, size), p, np.repeat(anchors, size)


class Family:
    """Levels of suffix arrays of one bucket. No content is in two levels; ``docs`` has its smallest document."""

    def __init__(self):
        self.levels: list[list[np.ndarray]] = []

    def add(self, anchors, contents, docs) -> tuple[np.ndarray, np.ndarray]:
        """Scan a new array against the levels, then take what is new as a level. Returns documents and contents of repeats."""
        late_docs, late = [], []
        anchors, contents, docs, new = _first_of(anchors, contents, docs)
        head = docs[np.flatnonzero(new)][np.cumsum(new) - 1] if len(docs) else docs
        again = docs > head
        late_docs.append(docs[again])
        late.append(contents[again])
        anchors, contents, docs = anchors[new], contents[new], docs[new]
        for level in self.levels:
            if not len(docs):
                break
            at = np.searchsorted(level[1], contents)
            at[at == len(level[1])] = 0
            met = (level[1][at] == contents) & (level[0][at] == anchors)
            if met.any():
                where, mine, theirs = at[met], docs[met], level[2][at[met]]
                late_docs.append(np.maximum(mine, theirs)[mine != theirs])
                late.append(contents[met][mine != theirs])
                level[2][where] = np.minimum(mine, theirs)
                anchors, contents, docs = anchors[~met], contents[~met], docs[~met]
        if len(docs):
            self.levels.append([anchors, contents, docs])
            while len(self.levels) > 1 and len(self.levels[-2][2]) <= 2 * len(self.levels[-1][2]):
                self._merge()
        return np.concatenate(late_docs), np.concatenate(late)

    def _merge(self) -> None:
        a, b = self.levels[-2:]
        anchors, contents, docs = (np.concatenate(x) for x in zip(a, b, strict=True))
        order = np.argsort(contents, kind="stable")
        self.levels[-2:] = [[anchors[order], contents[order], docs[order]]]

    def contested(self) -> tuple[np.ndarray, np.ndarray]:
        """Documents and contents of blocks that share an anchor with another block."""
        while len(self.levels) > 1:
            self._merge()
        if not self.levels:
            return np.zeros(0, np.int64), np.zeros(0, U)
        anchors, contents, docs = self.levels[0]
        order = np.argsort(anchors, kind="stable")
        s = anchors[order]
        same = np.zeros(len(s), bool)
        same[1:] = s[1:] == s[:-1]
        same[:-1] |= same[1:]
        return docs[order[same]], contents[order[same]]


def _scan(by_content: bool):
    """Suffix arrays, sorted by bucket, to the repeats and contested blocks of documents."""

    def found(docs, contents, state):
        n = len(docs)
        return pa.RecordBatch.from_arrays([pa.array(docs), pa.array(contents.view(np.int64)), pa.array(np.full(n, state, np.int32))], ["doc_id", "content", "state"])

    def task(batches):
        bucket, family, open_docs, open_contents = None, Family(), [], []

        def close():
            if not by_content:
                docs, contents = family.contested()
                docs, contents = np.concatenate([docs, *open_docs]), np.concatenate([contents, *open_contents])
                if len(docs):
                    yield found(docs, contents, CONTESTED)

        for batch in batches:
            for b, n, anchors, contents, docs, state in zip(*(batch.column(i).to_pylist() for i in range(6)), strict=True):
                anchors, contents, docs = unpack(anchors, n), unpack(contents, n), unpack(docs, n, np.int64)
                if state == REPEAT:
                    yield found(docs, contents, REPEAT)
                    continue
                if b != bucket:
                    yield from close()
                    bucket, family, open_docs, open_contents = b, Family(), [], []
                if state == CONTESTED:
                    open_docs.append(docs)
                    open_contents.append(contents)
                    # Content alone deals these out, so they have levels of their own in effect: no other block has them.
                late_docs, late = family.add(anchors, contents, docs)
                if len(late_docs):
                    yield found(late_docs, late, REPEAT)
        yield from close()

    return task


def _cut(length: int):
    """Texts with the contents and strings that repeat to what is left of them."""

    def task(batches):
        for part in pieces(batches, "text", CHUNK):
            data, at = flat(part.column(1))
            n = len(data)
            touched = valid(part.column(2)) | valid(part.column(3)) | valid(part.column(4))
            covered = np.zeros(n, bool)
            if touched.any():
                sizes = np.diff(at)
                own = np.repeat(touched, sizes)
                begin = np.concatenate([[0], np.cumsum(np.where(touched, sizes, 0))])
                hashes = Hashes(data[own], begin, length)
                row, first, last, _, contents = hashes.blocks()
                hit = np.isin(_tagged(row, contents), _members(part.column(2)))
                edges = np.zeros(len(hashes.rows) + length + 1, np.int64)
                np.add.at(edges, first[hit], 1)
                np.add.at(edges, last[hit] + length, -1)
                row, p, _ = _positions(hashes, _members(part.column(3)))
                p = p[np.isin(_tagged(row, hashes.content(p)), _members(part.column(4)))]
                np.add.at(edges, p, 1)
                np.add.at(edges, p + length, -1)
                covered[own] = np.cumsum(edges)[: len(hashes.rows)] > 0
            gone = np.concatenate([[0], np.cumsum(covered)])
            opens = covered.copy()
            opens[1:] &= ~covered[:-1]
            opens[at[:-1][at[:-1] < n]] = covered[at[:-1][at[:-1] < n]]
            spans = np.concatenate([[0], np.cumsum(opens)])
            kept = data[~covered]
            left = at - gone[at]
            body = pa.Array.from_buffers(pa.large_binary(), len(at) - 1, [None, pa.py_buffer(left.astype(np.int64).tobytes()), pa.py_buffer(kept.tobytes())]).cast(pa.binary())
            count = lambda x: pa.array(x[at[1:]] - x[at[:-1]], pa.int64())
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(np.diff(at), pa.int64()), count(gone), count(spans), body], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept"])

    return task


def remove_repeats(documents: DataFrame, length: int = 50, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Remove every byte that a string of ``length`` bytes covers which also starts in a document with a smaller id.

    Returns doc_id, n_bytes, n_removed, n_spans (maximal removed runs) and kept (binary). Strings are judged on the input;
    matches never cross documents. Null text is empty. Rows that share an id are each judged against smaller ids. A row
    without an id is kept whole and removes nothing. Other columns of the input, whatever their names, are not read.
    """
    if not GRAM + 1 <= length <= 88:
        raise ValueError(f"length must be {GRAM + 1} to 88 bytes")
    spark = documents.sparkSession
    ship(spark)
    buckets = buckets_of(spark)
    docs = documents.select(column(documents, doc_id, "doc_id", "bigint"), column(documents, text, "text", "string"))
    named = docs.filter(F.col("doc_id").isNotNull())

    def scanned(runs: DataFrame, by_content: bool) -> DataFrame:
        parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
        dealt = runs.repartition(parts, "bucket").sortWithinPartitions("bucket")
        return dealt.mapInArrow(_scan(by_content), FOUND)

    found = stored(scanned(named.mapInArrow(_index(length, buckets), RUNS), False), "suffix-found")
    lists = found.groupBy("doc_id").agg(
        F.collect_set(F.when(F.col("state") == REPEAT, F.col("content"))).alias("whole"),
        F.collect_set(F.when(F.col("state") == CONTESTED, F.col("content"))).alias("contested"),
    )
    lists = lists.select("doc_id", *(F.when(F.size(c) > 0, F.col(c)).alias(c) for c in ("whole", "contested")))
    # Both joins read one exchange of the texts.
    met = named.join(lists.hint("shuffle_hash"), "doc_id", "left").select("doc_id", "text", "contested", "whole")
    single = scanned(met.mapInArrow(_index_contested(length, buckets), RUNS), True)
    single = single.filter(F.col("state") == REPEAT).groupBy("doc_id").agg(F.collect_set("content").alias("single"))
    empty = F.lit(None).cast("array<bigint>")
    full = named.join(lists.hint("shuffle_hash"), "doc_id", "left").join(single.hint("shuffle_hash"), "doc_id", "left")
    full = full.select("doc_id", "text", "whole", "contested", "single")
    nameless = docs.filter(F.col("doc_id").isNull()).select("doc_id", "text", empty.alias("whole"), empty.alias("contested"), empty.alias("single"))
    return full.union(nameless).mapInArrow(_cut(length), "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary")
