"""Benchmark decontamination: passages of test items in training texts.

The items' windows of ``window`` consecutive words form a hash set that goes to every task (while it is small enough:
its size is counted first; a larger set goes in parts, one scan of the texts for each). A task normalises its texts to
lower-case words parted by one blank, so that a window is a byte range: prefix sums give the hash of every window at once, a
bitmap throws most away, and what is left is compared byte for byte with the item's window.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cartolex.llm.common import U, Spans, column, constants, flat, pieces, ship, stored

CHUNK = 1 << 20
#: Bytes of benchmark text whose windows one broadcast holds; its set of windows takes some ten times as much.
LARGEST = 8 << 20
BITS = 20
_CODES = constants(11, 256)

#: Word bytes: digits, lower-case letters and all bytes beyond ASCII, so that a word never splits a character.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
WORD = np.zeros(256, bool)
WORD[48:58] = WORD[97:123] = WORD[128:] = True


class Words:
    """Words of a buffer of texts, written one after another with a blank behind each."""

    def __init__(self, data: np.ndarray, at: np.ndarray):
        low = LOWER[data]
        word = WORD[low]
        begins = word.copy()
        begins[1:] &= ~word[:-1]
        inner = at[(at > 0) & (at < len(data))]
        begins[inner] = word[inner]
        first = np.flatnonzero(begins)
        # A word ends where no word byte follows, or the next text begins.
        ends = word.copy()
        ends[:-1] &= ~word[1:]
        ends[inner - 1] = word[inner - 1]
        last = np.flatnonzero(ends) + 1
        #: Where each word begins and ends in the texts, and its row.
        self.first, self.last = first, last
        self.row = np.searchsorted(at, first, "right") - 1
        size = last - first
        self.begin = np.concatenate([[0], np.cumsum(size + 1)[:-1]]).astype(np.int64) if len(size) else np.zeros(0, np.int64)
        self.end = self.begin + size
        self.body = np.full(int(size.sum()) + len(size), 32, np.uint8)
        place = np.ones(len(self.body), bool)
        place[self.end] = False
        self.body[place] = low[word]
        self.counts = np.bincount(self.row, minlength=len(at) - 1)

    def windows(self, size: int) -> np.ndarray:
        """The words at which a window of ``size`` words of one text begins."""
        if len(self.row) < size:
            return np.zeros(0, np.int64)
        return np.flatnonzero(self.row[: len(self.row) - size + 1] == self.row[size - 1 :])


class Windows:
    """Hash set of the windows of some items, by their number of words."""

    def __init__(self, items: list[tuple[int, str | None]], window: int):
        self.items: dict[bytes, set[int]] = {}
        by_size: dict[int, list[np.ndarray]] = {}
        shared: dict = {}
        for item, text in items:
            raw = np.frombuffer((text or "").encode(), np.uint8)
            words = Words(raw, np.array([0, len(raw)]))
            n = len(words.row)
            if not n:
                continue
            size = min(n, window)
            spans = Spans(words.body, _CODES, shared)
            start = words.windows(size)
            begin, end = words.begin[start], words.end[start + size - 1]
            by_size.setdefault(size, []).append(spans.of(begin, end))
            for a, b in zip(begin.tolist(), end.tolist(), strict=True):
                self.items.setdefault(words.body[a:b].tobytes(), set()).add(item)
        self.by_size = {}
        for size, found in by_size.items():
            bitmap = np.zeros(1 << BITS, bool)
            hashes = np.unique(np.concatenate(found))
            bitmap[(hashes & U((1 << BITS) - 1)).astype(np.int64)] = True
            self.by_size[size] = (bitmap, hashes)

    def hits(self, words: Words, spans: Spans):
        """First word, number of words and items of every occurrence, each compared byte for byte."""
        for size, (bitmap, hashes) in self.by_size.items():
            start = words.windows(size)
            if not len(start):
                continue
            h = spans.of(words.begin[start], words.end[start + size - 1])
            near = bitmap[(h & U((1 << BITS) - 1)).astype(np.int64)]
            start, h = start[near], h[near]
            at = np.searchsorted(hashes, h)
            at[at == len(hashes)] = 0
            start = start[hashes[at] == h]
            body = words.body
            for s, a, b in zip(start.tolist(), words.begin[start].tolist(), words.end[start + size - 1].tolist(), strict=True):
                items = self.items.get(body[a:b].tobytes())
                if items:
                    yield s, size, items


_built: dict[str, Windows] = {}


def windows_of(key: str, items: list[tuple[int, str | None]], window: int) -> Windows:
    """The set of one broadcast, built once in each worker; an older one goes."""
    if key not in _built:
        _built.clear()
        _built[key] = Windows(items, window)
    return _built[key]


def parts_of(benchmark: DataFrame, limit: int) -> Iterator[tuple[list, bool]]:
    """The items in lists of about ``limit`` bytes, and whether more follow; each is collected when it is asked for.

    One list, unless the benchmark is larger than a broadcast should be.
    """
    size = benchmark.agg(F.sum(F.octet_length("text")), F.max(F.octet_length("text"))).first()
    if (size[0] or 0) <= limit:
        yield benchmark.collect(), False
        return
    n = -(-size[0] // limit)
    part = F.pmod(F.xxhash64("item_id", "text"), F.lit(n))
    for k in range(n):
        yield benchmark.filter(part == k).collect(), k < n - 1


LEAKS = "doc_id long, n_words long, n_hit long, items array<long>, cuts array<int>"


def find_leaks(documents: DataFrame, benchmark: DataFrame, window: int = 10, limit: int = LARGEST, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Words of each text that lie in a window of ``window`` words that a benchmark item has too.

    An item of fewer words, but not none, is one window. Words are runs of ASCII letters (case aside), digits and characters
    beyond ASCII. Returns doc_id, n_words, n_hit (words in any occurrence), items (ids of the items that occur, sorted) and
    cuts: begin and end of each run of hit words as byte positions of the text in UTF-8, one after another. Null text has no
    words; rows that share an id, or have none, are judged one by one; null item ids count as -1; items that share an id are
    one item. Other columns are not read.
    """
    return _find(documents, benchmark, window, limit, doc_id, text, ())


def _find(documents: DataFrame, benchmark: DataFrame, window: int, limit: int, doc_id: str, text: str, keep: tuple[str, ...]) -> DataFrame:
    """As find_leaks, with the columns named in ``keep`` as keep_0, keep_1 and so on."""
    spark = documents.sparkSession
    ship(spark)
    carried = [f"keep_{i}" for i in range(len(keep))]
    docs = documents.select(
        column(documents, doc_id, "doc_id", "bigint"),
        column(documents, text, "text", "string"),
        F.expr("cast(array() as array<bigint>) as items"),
        F.expr("cast(array() as array<int>) as cuts"),
        *(F.col(f"`{k}`").alias(c) for k, c in zip(keep, carried, strict=True)),
    )
    items = benchmark.select(F.coalesce(F.col("item_id").cast("long"), F.lit(-1)).alias("item_id"), F.col("text").cast("string").alias("text"))
    for rows, more in parts_of(items, limit):
        docs = _scan(docs, [(r[0], r[1]) for r in rows], window, more)
        if more:
            docs = stored(docs, "leaks")
    return docs.select("doc_id", "n_words", "n_hit", "items", "cuts", *carried)


def _scan(docs: DataFrame, pairs: list, window: int, more: bool) -> DataFrame:
    """Add the hits of some items to those found before; the text stays if ``more`` items follow."""
    key = hashlib.sha256(repr((window, pairs)).encode()).hexdigest()
    held = docs.sparkSession.sparkContext.broadcast((key, pairs))
    before = docs.drop("n_words", "n_hit")
    carried = before.columns[4:]

    def task(batches):
        windows = windows_of(*held.value, window)
        shared: dict = {}
        for part in pieces(batches, "text", CHUNK):
            data, at = flat(part.column(1))
            words = Words(data, at)
            n, n_words = len(at) - 1, len(words.row)
            found = [set(x or ()) for x in part.column(2).to_pylist()]
            edges = np.zeros(n_words + 1, np.int64)
            # What earlier items hit, as words again.
            old = part.column(3).flatten().to_numpy(zero_copy_only=False).astype(np.int64)
            if len(old):
                old += np.repeat(at[:-1], part.column(3).value_lengths().to_numpy(zero_copy_only=False))
                np.add.at(edges, np.searchsorted(words.first, old[0::2]), 1)
                np.add.at(edges, np.searchsorted(words.last, old[1::2]) + 1, -1)
            for s, size, own in windows.hits(words, Spans(words.body, _CODES, shared)):
                edges[s] += 1
                edges[s + size] -= 1
                found[words.row[s]] |= own
            hit = np.cumsum(edges)[:-1] > 0
            apart = words.row[1:] != words.row[:-1]
            opens, closes = hit.copy(), hit.copy()
            opens[1:] &= ~hit[:-1] | apart
            closes[:-1] &= ~hit[1:] | apart
            row = words.row[opens]
            cuts = np.stack([words.first[opens] - at[row], words.last[closes] - at[row]], 1).reshape(-1).astype(np.int32)
            bound = np.concatenate([[0], np.cumsum(2 * np.bincount(row, minlength=n))]).astype(np.int32)
            out = [part.column(0), part.column(1)] if more else [part.column(0)]
            out += [pa.array([sorted(x) for x in found], pa.list_(pa.int64())), pa.ListArray.from_arrays(pa.array(bound), pa.array(cuts)), *part.columns[4:]]
            counts = [words.counts, np.bincount(words.row[hit], minlength=n)]
            yield pa.RecordBatch.from_arrays([*out, *(pa.array(c.astype(np.int64)) for c in counts)], names)

    names = ["doc_id", *["text"] * more, "items", "cuts", *carried, "n_words", "n_hit"]
    schema = before.select(*names[:-2]).withColumns({"n_words": F.lit(0).cast("long"), "n_hit": F.lit(0).cast("long")}).schema
    return before.mapInArrow(task, T.StructType([T.StructField(f.name, f.dataType) for f in schema]))


def cut_leaks(documents: DataFrame, benchmark: DataFrame, window: int = 10, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The documents without the passages that benchmark items share; a document that is nothing else goes.

    Columns stay as they are, but for the cut ``text`` (and ``n_chars``, where there is one). A text without such a passage is
    left alone, a null or empty one too.
    """
    names = documents.columns
    found = _find(documents, benchmark, window, LARGEST, doc_id, text, tuple(names))
    held = {n: F.col(f"keep_{i}") for i, n in enumerate(names)}
    raw = held[text].cast("binary")
    # Pieces between the runs: from the end of one to the begin of the next.
    ends = F.concat(F.array(F.lit(0)), F.filter("cuts", lambda _, i: i % 2 == 1))
    begins = F.concat(F.filter("cuts", lambda _, i: i % 2 == 0), F.array(F.octet_length(raw)))
    left = F.transform(F.arrays_zip(ends.alias("e"), begins.alias("b")), lambda x: F.substring(raw, x["e"] + 1, x["b"] - x["e"]).cast("string"))
    touched = F.col("n_hit") > 0
    cut = F.array_join(left, "")
    values = held | {text: F.when(touched, cut).otherwise(held[text])}
    if "n_chars" in names:
        values["n_chars"] = F.when(touched, F.length(cut).cast("long")).otherwise(held["n_chars"])
    return found.filter(~touched | (F.col("n_hit") < F.col("n_words"))).select(*(values[n].alias(n) for n in names))
