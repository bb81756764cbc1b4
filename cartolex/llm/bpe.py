"""Byte-level BPE: texts to token ids and back.

A piece of text starts as single bytes. A segment tree over its byte positions holds, at the leaf of each live position,
the rank of the pair that begins there, joined with the position; so the root is the leftmost pair of least rank. A merge
updates three leaves (the pair's own, its dead neighbour's, the pair to the left) and the path above each. Pieces of up to
``WIDE`` bytes run in lockstep, one tree to a row of an array; a longer piece has a tree of its own.
"""

from __future__ import annotations

import base64
import hashlib
import re
from itertools import islice

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from cartolex.llm.common import flat, lean, pieces, ship

#: Bytes of the longest piece that is merged in lockstep with others, and pieces merged at a time.
WIDE, ROWS = 32, 4_000
#: Words, and pieces of words, whose ids a worker remembers.
REMEMBERED = 100_000
#: Bytes of text taken at a time; characters of a text split at a time.
CHUNK, SPLIT = 2 << 20, 4 << 20
#: A vocabulary larger than this is no broadcast.
LARGEST_FILE = 64 << 20
#: Bits of a position in a piece; the rank of a leaf stands before them.
BITS = (WIDE - 1).bit_length()

_WHITE = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
#: Words with their blank, and white space, of a pattern that never joins two of them (as that of the public rank files).
WORDS = rf" ?[^{_WHITE}]+|[{_WHITE}]+(?![^{_WHITE}])|[{_WHITE}]+"


def read_ranks(content: bytes) -> dict[bytes, int]:
    """Bytes of each token and its rank, from lines of base64 and number."""
    return {base64.b64decode(a): int(b) for a, b in (line.split() for line in content.splitlines() if line.strip())}


class Codec:
    """The merges of one rank file and the pattern that splits texts, if given after a quick split into words."""

    def __init__(self, content: bytes, pattern: str, words: str | None = None):
        self.ranks = read_ranks(content)
        self.pattern = regex.compile(pattern)
        self.words = re.compile(words) if words else self.pattern
        self.kind = np.int64 if max(self.ranks.values(), default=0) >> 31 - BITS else np.int32
        self.none = np.iinfo(self.kind).max
        self.single = np.array([self.ranks[bytes([i])] for i in range(256)], self.kind)
        self.pairs = {}
        for token, rank in self.ranks.items():
            for cut in range(1, len(token)):
                left, right = self.ranks.get(token[:cut]), self.ranks.get(token[cut:])
                if left is not None and right is not None:
                    self.pairs[left << 32 | right] = rank
        self.keys = np.sort(np.fromiter(self.pairs, np.int64, len(self.pairs)))
        self.merged = np.fromiter((self.pairs[k] for k in self.keys.tolist()), self.kind, len(self.pairs))
        self.whole = {token: rank.to_bytes(4, "little") for token, rank in self.ranks.items()}
        self.known: dict[str, bytes] = {}
        self.merges: dict[str, bytes] = {}

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of the token that each pair makes, or -1."""
        key = left.astype(np.int64) << 32 | right
        at = np.searchsorted(self.keys, key)
        at[at == len(self.keys)] = 0
        return np.where(self.keys[at] == key, self.merged[at], self.kind(-1))

    # ---- merging

    def together(self, words: list[bytes], width: int) -> list[bytes]:
        """Ids, as little-endian 32-bit numbers, of pieces of at most ``width`` bytes (a power of two)."""
        n = len(words)
        size = np.fromiter(map(len, words), np.int64, n)
        raw = np.frombuffer(b"".join(w.ljust(width, b"\0") for w in words), np.uint8).reshape(n, width)
        place = np.arange(width, dtype=self.kind)
        token = self.single[raw]
        after = np.tile(place + 1, (n, 1))
        before = np.tile(place - 1, (n, 1))
        tree = np.full((n, 2 * width), self.none, self.kind)
        if width > 1:
            leaf = self.rank(token[:, :-1].reshape(-1), token[:, 1:].reshape(-1)).reshape(n, -1)
            leaf[place[1:][None, :] >= size[:, None]] = -1
            tree[:, width : 2 * width - 1] = np.where(leaf < 0, self.none, leaf << BITS | place[:-1])
        for k in range(width - 1, 0, -1):
            tree[:, k] = np.minimum(tree[:, 2 * k], tree[:, 2 * k + 1])
        live = place[None, :] < size[:, None]

        def update(rows, at, value):
            k = at + width
            tree[rows, k] = value
            while (k := k >> 1)[0]:
                tree[rows, k] = np.minimum(tree[rows, 2 * k], tree[rows, 2 * k + 1])

        def pair(rows, at):
            """The leaf of the pair that begins at a live position."""
            to = after[rows, at]
            there = to < size[rows]
            rank = np.where(there, self.rank(token[rows, at], token[rows, np.where(there, to, at)]), self.kind(-1))
            return np.where(rank < 0, self.none, rank << BITS | at)

        rows = np.flatnonzero(tree[:, 1] < self.none)
        while len(rows):
            least = tree[rows, 1]
            at = least & ((1 << BITS) - 1)
            dead = after[rows, at]
            token[rows, at] = least >> BITS
            live[rows, dead] = False
            to = after[rows, dead]
            after[rows, at] = to
            inside = to < size[rows]
            before[rows[inside], to[inside]] = at[inside]
            update(rows, dead, self.none)
            update(rows, at, pair(rows, at))
            left = before[rows, at]
            has = left >= 0
            if has.any():
                update(rows[has], left[has], pair(rows[has], left[has]))
            rows = rows[tree[rows, 1] < self.none]
        ids = token[live].astype("<i4").tobytes()
        ends = np.cumsum(live.sum(1)) * 4
        return [ids[a:b] for a, b in zip([0, *ends[:-1].tolist()], ends.tolist(), strict=True)]

    def alone(self, word: bytes) -> bytes:
        """Ids of one long piece."""
        n = len(word)
        width = 1 << (n - 1).bit_length()
        token = self.single[np.frombuffer(word, np.uint8)].tolist()
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        pairs, none = self.pairs, (1 << 62, 0)

        def leaf(i):
            j = after[i]
            rank = pairs.get(token[i] << 32 | token[j]) if j < n else None
            return none if rank is None else (rank, i)

        tree = [none] * width + [leaf(i) for i in range(n)] + [none] * (width - n)
        for k in range(width - 1, 0, -1):
            tree[k] = min(tree[2 * k], tree[2 * k + 1])

        def update(i, value):
            k = i + width
            tree[k] = value
            while k := k >> 1:
                tree[k] = min(tree[2 * k], tree[2 * k + 1])

        while tree[1] is not none and tree[1] != none:
            rank, i = tree[1]
            dead = after[i]
            token[i], token[dead] = rank, -1
            after[i] = after[dead]
            if after[i] < n:
                before[after[i]] = i
            update(dead, none)
            update(i, leaf(i))
            if before[i] >= 0:
                update(before[i], leaf(before[i]))
        return np.array([t for t in token if t >= 0], "<i4").tobytes()

    def learn(self, words: set[str]) -> None:
        """Find the ids of words not met before."""
        if len(self.known) + len(words) > REMEMBERED:
            self.known.clear()
        split = {w: self.pattern.findall(w) for w in words}
        found = set().union(*split.values())
        new = found.difference(self.merges)
        if len(self.merges) + len(new) > REMEMBERED:
            self.merges.clear()
            new = found
        self.merge(new)
        merges = self.merges
        self.known.update({word: merges[word] if len(own) == 1 else b"".join([merges[p] for p in own]) for word, own in split.items()})

    def merge(self, new: set[str]) -> None:
        """Find the ids of pieces not met before."""
        by_width: dict[int, tuple[list[str], list[bytes]]] = {1 << k: ([], []) for k in range(WIDE.bit_length())}
        dealt = [by_width[1 << (n - 1).bit_length()] if n else None for n in range(WIDE + 1)]
        listed = list(new)
        raws = [p.encode() for p in listed]
        for piece, raw, whole in zip(listed, raws, map(self.whole.get, raws), strict=True):
            if whole is not None:
                self.merges[piece] = whole
            elif len(raw) > WIDE:
                self.merges[piece] = self.alone(raw)
            else:
                names, group = dealt[len(raw)]
                names.append(piece)
                group.append(raw)
        for width, (names, group) in by_width.items():
            for k in range(0, len(group), ROWS):
                self.merges.update(zip(names[k : k + ROWS], self.together(group[k : k + ROWS], width), strict=True))

    # ---- texts

    def split(self, text: str):
        """Lists of the words of a text; a long text in several."""
        if len(text) <= SPLIT:
            return [self.words.findall(text)]
        found = (m.group() for m in self.words.finditer(text))
        return iter(lambda: list(islice(found, SPLIT // 8)), [])

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian 32-bit numbers."""
        out: list[bytes] = []
        held: list[list[list[str]]] = []
        for text in texts:
            if len(text) <= SPLIT:
                held.append([self.words.findall(text)])
                continue
            # A long text is split and encoded part by part.
            out += self._flush(held)
            held = []
            out.append(b"".join(self._flush([[some]])[0] for some in self.split(text)))
        return out + self._flush(held)

    def _flush(self, held: list[list[list[str]]]) -> list[bytes]:
        words = set().union(*(some for own in held for some in own))
        new = words.difference(self.known)
        if new:
            self.learn(new if len(self.known) + len(new) <= REMEMBERED else words)
        find = self.known.__getitem__
        return [b"".join([i for some in own for i in map(find, some)]) for own in held]


_codecs: dict[tuple, Codec] = {}
_tables: dict[str, dict[int, bytes]] = {}


def bytes_of(content: bytes) -> dict[int, bytes]:
    """Bytes by id of a rank file, all that decoding needs; built once in each worker."""
    key = hashlib.sha256(content).hexdigest()
    if key not in _tables:
        _tables[key] = {r: b for b, r in read_ranks(content).items()}
    return _tables[key]


def codec(content: bytes, pattern: str, words: str | None = None) -> Codec:
    """The codec of a rank file, built once in each worker."""
    key = (hashlib.sha256(content).hexdigest(), pattern, words)
    if key not in _codecs:
        _codecs[key] = Codec(content, pattern, words)
    return _codecs[key]


def read_file(path: str) -> bytes:
    with open(path, "rb") as f:
        content = f.read(LARGEST_FILE + 1)
    if len(content) > LARGEST_FILE:
        raise ValueError(f"{path} is larger than {LARGEST_FILE} bytes")
    return content


def _plain(n: int) -> list[str]:
    return [f"c{i}" for i in range(n)]


def _mapped(frame: DataFrame, task, schema: StructType) -> DataFrame:
    """``mapInArrow`` under plain names, since it resolves a dot in a column's name as a field."""
    inside = StructType([StructField(n, f.dataType) for n, f in zip(_plain(len(schema)), schema, strict=True)])
    return frame.toDF(*_plain(len(frame.columns))).mapInArrow(task, inside).toDF(*schema.names)


def encode(documents: DataFrame, path: str, pattern: str, words: str | None = None, text: str = "text", ids: str = "ids") -> DataFrame:
    """The rows with ``ids`` (array of int), the tokens of the whole ``text`` without special tokens.

    ``words`` is a quicker regular expression whose matches end only where a match of ``pattern`` ends too; see WORDS. A null or empty text has no tokens.
    Repeated rows are encoded one by one, an empty table gives no rows. All other columns stay; one named like ``ids`` is replaced.
    """
    spark = documents.sparkSession
    ship(spark)
    held = spark.sparkContext.broadcast((read_file(path), pattern, words))
    keep = [c for c in documents.columns if c != ids]
    place = keep.index(text)

    def task(batches):
        own = codec(*held.value)
        for batch in batches:
            for part in pieces([batch], batch.schema.names[place], CHUNK):
                found = own.encode(part.column(place).fill_null("").to_pylist())
                at = np.concatenate([[0], np.cumsum([len(x) // 4 for x in found])]).astype(np.int32)
                values = pa.array(np.frombuffer(b"".join(found), "<i4"), pa.int32())
                yield pa.RecordBatch.from_arrays([*part.columns, pa.ListArray.from_arrays(pa.array(at), values)], _plain(len(keep) + 1))

    kept = [F.col(f"`{c}`").cast("string").alias(c) if c == text else F.col(f"`{c}`") for c in keep]
    schema = documents.select(*kept, F.lit(None).cast("array<int>").alias(ids)).schema
    return _mapped(documents.select(*kept), lean(task), schema)


def decode(frame: DataFrame, path: str, ids: str = "ids", to: str = "decoded") -> DataFrame:
    """The rows with ``to`` (binary), the bytes of their ``ids``. All other columns stay.

    Null ids give no bytes; an id that the file lacks is an error of the caller and raises.
    """
    spark = frame.sparkSession
    ship(spark)
    held = spark.sparkContext.broadcast(read_file(path))
    keep = [c for c in frame.columns if c != to]
    place = keep.index(ids)

    def task(batches):
        find = bytes_of(held.value).__getitem__
        for batch in batches:
            column = batch.column(place)
            values = column.flatten().to_numpy(zero_copy_only=False)
            at = np.concatenate([[0], np.cumsum(column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))])
            found = [b"".join(map(find, values[a:b].tolist())) for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, pa.binary())], _plain(len(keep) + 1))

    kept = [F.col(f"`{c}`") for c in keep]
    return _mapped(frame.select(*kept), lean(task), frame.select(*kept, F.lit(None).cast("binary").alias(to)).schema)
