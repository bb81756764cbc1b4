"""Phrases whose words stand together more often than apart, from a prefix-free parse.

A text is a row of words with breaks between its pieces. Where a window of ``longest - 1`` words hashes to a multiple of
``PERIOD``, a chunk begins; it runs to the end of the window that begins the next one. So chunks overlap by a window, equal
passages are cut alike wherever they stand, and each run of up to ``longest`` words lies whole in a chunk. The dictionary holds
each distinct chunk of a language once, with its frequency in the parse. Phrases are counted in distinct chunks, weighted; one
that begins in the overlap belongs to the next chunk alone, so each occurrence counts once.

Longer phrases are counted only where both their parts of one word less are frequent, which a hash table of fixed size tells:
it may let too many through, never too few, and the counts that follow are exact.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cartolex.llm.common import Spans, U, column, constants, flat, hash_bits, in_bits, mix, pieces, ship, stored

CHUNK = 1 << 20
#: Bytes of chunks that a task counts together.
COUNTED = 1 << 23
#: Words of a chunk on average.
PERIOD = 32
_CODES = constants(53, 256)
_C = constants(59, 6)

BREAK = np.zeros(256, bool)
BREAK[[*b".,;:!?\n\x0b\f\r"]] = True
BLANK = BREAK.copy()
BLANK[[*b" \t"]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

DICTIONARY = "lang string, chunk string, tail int"
GRAMS = "lang string, phrase string, n long"


def _ranges(data: np.ndarray, first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of the ranges one after another, and where each begins."""
    sizes = last - first
    at = np.concatenate([[0], np.cumsum(sizes)])
    return data[np.arange(at[-1]) + np.repeat(first - at[:-1], sizes)], at


def parse(data: np.ndarray, at: np.ndarray, overlap: int, period: int, shared: dict):
    """Chunks of the texts: row, bytes, offsets and how many words at the end belong to the next chunk.

    Words are parted by a blank, pieces by a line end; each chunk ends with one.
    """
    low = LOWER[data]
    word = ~BLANK[low]
    inner = at[(at > 0) & (at < len(data))]
    begins, closes = word.copy(), word.copy()
    begins[1:] &= ~word[:-1]
    begins[inner] = word[inner]
    closes[:-1] &= ~word[1:]
    closes[inner - 1] = word[inner - 1]
    first, last = np.flatnonzero(begins), np.flatnonzero(closes) + 1
    n = len(first)
    row = np.searchsorted(at, first, "right") - 1
    if not n:
        return row, np.zeros(0, np.uint8), np.zeros(1, np.int64), row
    ends = np.ones(n, bool)  # the row's last word
    ends[:-1] = row[1:] != row[:-1]
    breaks = np.concatenate([[0], np.cumsum(BREAK[low])])
    parted = ends.copy()  # no phrase goes on after this word
    parted[:-1] |= breaks[first[1:]] > breaks[last[:-1]]
    h = Spans(low, _CODES, shared).of(first, last) + parted.astype(U) * _C[0]
    window = np.zeros(max(0, n - overlap + 1), U)
    for i in range(overlap):
        # Whether the window's last word ends a piece is not part of it.
        own = h[i : i + len(window)] if i < overlap - 1 else (h - parted.astype(U) * _C[0])[i : i + len(window)]
        window = (window ^ (window >> U(29))) * _C[1] + own * _C[2]
    opens = np.ones(n, bool)
    opens[1:] = ends[:-1]
    fits = row[: len(window)] == row[overlap - 1 :]
    opens[: len(window)] |= fits & (mix(window) % U(period) == 0)
    start = np.flatnonzero(opens)
    stop = np.append(start[1:], n)
    # Words from the next chunk's window, where that is in the same row.
    final = np.flatnonzero(ends)[np.searchsorted(np.flatnonzero(ends), start)] + 1
    tail = np.where(stop < final, overlap, 0)
    # Words with one parting byte each: then chunks are ranges of bytes.
    clean, place = _ranges(low, first, np.minimum(last + 1, len(low)))
    if last[-1] == len(low):
        clean, place[-1] = np.append(clean, np.uint8(10)), place[-1] + 1
    joined = np.flatnonzero(ends[:-1] & (last[:-1] == first[1:]))  # texts that touch: no byte parts them
    if len(joined):
        sizes = last - first + 1
        place = np.concatenate([[0], np.cumsum(sizes)])
        clean = np.zeros(place[-1], np.uint8)
        body = np.ones(place[-1], bool)
        body[place[1:] - 1] = False
        clean[body] = low[word]
    clean[place[1:] - 1] = np.where(parted, 10, 32)
    text, offsets = _ranges(clean, place[start], place[stop + tail])
    text[offsets[1:] - 1] = 10
    return row[start], text, offsets, tail


def _dictionary(overlap: int, period: int):
    def task(batches):
        shared: dict = {}
        for part in pieces(batches, "text", CHUNK):
            rows, text, offsets, tail = parse(*flat(part.column(1)), overlap, period, shared)
            chunks = pa.Array.from_buffers(pa.large_utf8(), len(rows), [None, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(text)])
            yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(rows)), chunks.cast(pa.string()), pa.array(tail.astype(np.int32))], ["lang", "chunk", "tail"])

    return task


class Chunks:
    """Words of a batch of chunks, numbered within their languages."""

    def __init__(self, table: pa.Table):
        data, at = flat(table.column("chunk"))
        end = np.flatnonzero((data == 32) | (data == 10))
        self.parted = data[end] == 10
        begin = np.concatenate([[0], end[:-1] + 1]) if len(end) else end
        data = np.where(data == 10, np.uint8(32), data)
        offsets = np.concatenate([[0], end + 1]).astype(np.int64)
        coded = pa.Array.from_buffers(pa.large_binary(), len(end), [None, pa.py_buffer(offsets), pa.py_buffer(data)]).dictionary_encode()
        self.words = coded.dictionary
        self.row = np.searchsorted(at, begin, "right") - 1
        langs = table.column("lang").combine_chunks().dictionary_encode()
        self.langs = langs.dictionary
        code = coded.indices.to_numpy().astype(np.int64)
        self.lang = langs.indices.to_numpy().astype(np.int64)[self.row]
        self.pairs, self.own = np.unique(self.lang * max(1, len(self.words)) + code, return_inverse=True)
        sizes = np.bincount(self.row, minlength=len(at) - 1)
        place = np.arange(len(end)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        self.counts = place < (sizes - longs_of(table.column("tail")))[self.row]
        self.weight = longs_of(table.column("n"))[self.row]
        held, offsets = flat(self.words)
        marks = mix(Spans(held, _CODES, {}).of(offsets[:-1], offsets[1:] - 1))
        names, ends = flat(self.langs)
        self.hash = marks[self.pairs % max(1, len(self.words))] + mix(Spans(names, _CODES, {}).of(ends[:-1], ends[1:]) + _C[3])[self.pairs // max(1, len(self.words))]

    def grams(self, size: int, bits: np.ndarray | None) -> pa.Table:
        """Phrases of ``size`` words with their weights, of those whose two parts have their bits."""
        n = max(0, len(self.own) - size + 1)
        whole = self.counts[:n].copy()
        for i in range(size - 1):
            whole &= ~self.parted[i : i + n]
        if bits is not None:
            part = in_bits(bits, self._hash(size - 1))
            whole &= part[:n] & part[1 : n + 1]
        start = np.flatnonzero(whole)
        key = self.own[start]
        for i in range(1, size):
            # Numbers of shorter phrases, made dense again, so that no product passes 64 bits.
            key = np.unique(key, return_inverse=True)[1] * len(self.pairs) + self.own[start + i]
        _, lead, inverse = np.unique(key, return_index=True, return_inverse=True)
        weight = np.zeros(len(lead), np.int64)
        np.add.at(weight, inverse, self.weight[start])
        lead = start[lead]
        words = [self.words.take(pa.array(self.pairs[self.own[lead + i]] % max(1, len(self.words)))) for i in range(size)]
        phrase = pc.binary_slice(pc.binary_join_element_wise(*words, pa.scalar(b"", pa.large_binary())), 0, -1) if len(lead) else pa.array([], pa.binary())
        return pa.table({"lang": self.langs.take(pa.array(self.lang[lead])), "phrase": phrase.cast(pa.binary()).cast(pa.string()), "n": pa.array(weight)})

    def _hash(self, size: int) -> np.ndarray:
        """A hash of the ``size`` words from each place on (nothing of use at the last places)."""
        own = self.hash[self.own]
        total = own
        for i in range(1, size):
            total = fold(total, np.append(own[i:], np.zeros(i, U)))
        return total


def fold(total: np.ndarray, word: np.ndarray) -> np.ndarray:
    return mix(total * _C[4] + word * _C[5])


def longs_of(column) -> np.ndarray:
    return column.combine_chunks().to_numpy(zero_copy_only=False).astype(np.int64)


def _grams(size: int, wanted):
    def task(batches):
        held, total = [], 0
        bits = wanted.value if wanted is not None else None

        def counted():
            return Chunks(pa.Table.from_batches(held)).grams(size, bits).to_batches()

        for batch in batches:
            held.append(batch)
            total += batch.nbytes
            if total >= COUNTED:
                yield from counted()
                held, total = [], 0
        if total:
            yield from counted()

    return task


def _hashes(size: int):
    """The hash by which a task knows a phrase of a language."""

    def task(batches):
        for batch in batches:
            table = pa.table({"lang": batch.column(0), "chunk": pc.binary_join_element_wise(batch.column(1), "\n", ""), "tail": pa.array(np.zeros(batch.num_rows, np.int32)), "n": pa.array(np.ones(batch.num_rows, np.int64))})
            found = Chunks(table) if batch.num_rows else None
            out = found._hash(size)[::size] if found else np.zeros(0, U)
            yield pa.RecordBatch.from_arrays([pa.array(out.view(np.int64))], ["h"])

    return task


def phrase_counts(documents: DataFrame, longest: int = 3, least: int = 10, period: int = PERIOD, text: str = "text", lang: str = "lang") -> tuple[DataFrame, DataFrame]:
    """How often the phrases of up to ``longest`` words occur, of those that occur ``least`` times, and words in all.

    Texts are lower-cased (A-Z) and split at . , ; : ! ? and line ends into pieces, these at blanks and tabs into words; phrases
    lie in a piece, and occurrences may overlap. Returns (lang, phrase, size, f) and (lang, n). Null text has no words; a null
    language is ``und``. Other columns are not read. Results are stored tables.
    """
    spark = documents.sparkSession
    ship(spark)
    if longest < 2:
        raise ValueError("a phrase has two words at least")
    named = F.coalesce(F.col(f"`{lang}`").cast("string"), F.lit("und")).alias("lang")
    docs = documents.select(named, column(documents, text, "text", "string"))
    chunks = docs.mapInArrow(_dictionary(longest - 1, period), DICTIONARY)
    dictionary = stored(chunks.groupBy("lang", "chunk", "tail").agg(F.count("*").alias("n")), "parse-dictionary")
    found, wanted, words = [], None, None
    for size in range(1, longest + 1):
        grams = dictionary.mapInArrow(_grams(size, wanted), GRAMS).groupBy("lang", "phrase").agg(F.sum("n").alias("f"))
        if size == 1:
            every = stored(grams, "words")
            words = every.groupBy("lang").agg(F.sum("f").alias("n"))
            frequent = every.filter(F.col("f") >= least)
        else:
            frequent = stored(grams.filter(F.col("f") >= least), f"phrases-{size}")
        if size < longest:
            wanted = spark.sparkContext.broadcast(hash_bits(frequent.select("lang", "phrase").mapInArrow(_hashes(size), "h long")))
        found.append(frequent.select("lang", "phrase", F.lit(size).alias("size"), "f"))
    counts = found[0]
    for more in found[1:]:
        counts = counts.unionByName(more)
    return counts, words


def collocations(documents: DataFrame, longest: int = 3, least: int = 10, covered: int = 50, top: int | None = 2000, period: int = PERIOD, text: str = "text", lang: str = "lang") -> DataFrame:
    """The phrases of each language that hold together best, as ``phrase_counts`` counts them.

    A phrase of 2 to ``longest`` words that occurs a >= ``least`` times is cut after each of its words into parts that occur
    l and r times; its score is the least of floor(1000000 * a * a / (l * r)), ties to the first cut. Phrases that lie in a
    longer one with at least ``covered`` percent of their occurrences are left out. Returns lang, rank, phrase, a, l, r, n
    (words of the language) and score of the first ``top`` (None: all) by score and a, both falling, then phrase in order of
    its bytes. Arithmetic is exact while a stays below 10**16.
    """
    counts, words = phrase_counts(documents, longest, least, period, text, lang)
    phrases = counts.filter("size > 1").select("lang", "phrase", "size", F.col("f").alias("a"))
    parts = counts.select("lang", F.col("phrase").alias("part"), F.col("f"))
    listed = F.split("phrase", " ")

    def join(first, size):
        return F.array_join(F.slice(listed, first, size), " ")

    cuts = phrases.withColumn("k", F.explode(F.sequence(F.lit(1), F.col("size") - 1)))
    cuts = cuts.select("lang", "phrase", "a", "k", join(F.lit(1), F.col("k")).alias("left"), join(F.col("k") + 1, F.col("size") - F.col("k")).alias("right"))
    cuts = cuts.join(parts.select("lang", F.col("part").alias("left"), F.col("f").alias("l")), ["lang", "left"])
    cuts = cuts.join(parts.select("lang", F.col("part").alias("right"), F.col("f").alias("r")), ["lang", "right"])
    score = F.expr("(cast(a as decimal(16,0)) * cast(a as decimal(16,0)) * 1000000) div (cast(l as decimal(19,0)) * cast(r as decimal(19,0)))")
    best = cuts.groupBy("lang", "phrase").agg(F.min(F.struct(score.alias("score"), "k", "a", "l", "r")).alias("cut")).select("lang", "phrase", "cut.*")
    # What each longer phrase covers: all its shorter ones, with its count.
    longer = phrases.filter("size > 2").withColumn("part_size", F.explode(F.sequence(F.lit(2), F.col("size") - 1)))
    longer = longer.withColumn("at", F.explode(F.sequence(F.lit(1), F.col("size") - F.col("part_size") + 1)))
    over = longer.groupBy("lang", join(F.col("at"), F.col("part_size")).alias("phrase")).agg(F.max("a").alias("most"))
    kept = best.join(over, ["lang", "phrase"], "left").filter(F.col("most").isNull() | (F.col("most") * 100 < F.lit(covered) * F.col("a")))
    order = W.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    ranked = kept.withColumn("rank", F.row_number().over(order))
    if top is not None:
        ranked = ranked.filter(F.col("rank") <= top)
    return ranked.join(words, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
