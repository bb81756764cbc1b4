"""Near-duplicate documents with HyperMinHash.

A document is the set of its distinct word shingles. Its signature has ``REGISTERS`` buckets; a bucket keeps, of the least
hash that falls into it, the number of leading zeros and the next ten bits: two bytes. Bands of ``BAND`` registers, empty
ones filled from others by a fixed order of search, are the keys under which documents meet.

Equal sets become one class first, so copies cost one row. A document is paired with the centre of one large band, not with
all members of all its bands.
A pair passes by sizes, by the Jaccard estimate corrected for registers that agree by chance (with a margin of six standard
deviations), then by the full sets. Bands whose members are then not all known to belong together are settled in memory, in
slices of bounded size: what lies outside a band's largest component is compared with that and with each other. So no link
between documents that share a band is lost, and no pairs are listed.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cartolex.llm.common import U, Spans, column, constants, flat, lean, longs, mix, pieces, ship, stored

REGISTERS, BAND = 384, 6
BANDS = REGISTERS // BAND
MANTISSA = 10
EMPTY = np.uint16(0xFFFF)
CHUNK = 1 << 20
#: Standard deviations below the threshold at which an estimate still goes on to the full sets.
MARGIN = 6.0
#: Bands of so many members are compared at once, pair by pair.
SMALL = 8
#: Texts compared with one centre, or held in memory to be compared with others, in one task.
SLICE = 500
_CODES = constants(23, 256)
_C = constants(29, 8)
_PROBES = (mix(np.arange(96 * REGISTERS, dtype=U) + U(77)) % U(REGISTERS)).astype(np.int64).reshape(96, REGISTERS)

SPACE = np.zeros(256, bool)
SPACE[9:14] = SPACE[32] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def shingles(data: np.ndarray, at: np.ndarray, words: int, shared: dict) -> tuple[np.ndarray, np.ndarray]:
    """Row and hash of each distinct shingle of each text, in order of row and hash.

    Words are what white space (blank, \\t to \\r) parts, A-Z lower-cased. A text of fewer words than a shingle has, but not
    none, is one shingle.
    """
    low = LOWER[data]
    word = ~SPACE[low]
    begins = word.copy()
    begins[1:] &= ~word[:-1]
    inner = at[(at > 0) & (at < len(data))]
    begins[inner] = word[inner]
    first = np.flatnonzero(begins)
    ends = word.copy()
    ends[:-1] &= ~word[1:]
    ends[inner - 1] = word[inner - 1]
    last = np.flatnonzero(ends) + 1
    row = np.searchsorted(at, first, "right") - 1
    h = Spans(low, _CODES, shared).of(first, last)
    n = len(h)
    total = np.zeros(max(0, n - words + 1), U)
    for i in range(words):
        total = (total ^ (total >> U(29))) * _C[0] + h[i : i + len(total)] * _C[1]
    whole = row[: len(total)] == row[words - 1 :] if n >= words else np.zeros(0, bool)
    rows, found = row[: len(total)][whole], mix(total[whole])
    counts = np.bincount(row, minlength=len(at) - 1)
    few = np.flatnonzero((counts > 0) & (counts < words))
    if len(few):
        start = np.cumsum(counts) - counts
        short = np.zeros(len(few), U)
        for i in range(words - 1):
            has = counts[few] > i
            short[has] = (short[has] ^ (short[has] >> U(29))) * _C[2] + h[(start[few] + i)[has]] * _C[3]
        rows, found = np.concatenate([rows, few]), np.concatenate([found, mix(short + counts[few].astype(U))])
    order = np.lexsort((found, rows))
    rows, found = rows[order], found[order]
    new = np.ones(len(rows), bool)
    new[1:] = (rows[1:] != rows[:-1]) | (found[1:] != found[:-1])
    return rows[new], found[new]


def signatures(rows: np.ndarray, hashes: np.ndarray, n: int) -> np.ndarray:
    """Registers of n texts from their shingles, which come in order of row and hash."""
    out = np.full((n, REGISTERS), EMPTY)
    if not len(rows):
        return out
    # The bucket is the leading part of the hash, so the first hash of a bucket is its least.
    scaled = (hashes >> U(32)) * U(REGISTERS)
    bucket = (scaled >> U(32)).astype(np.int64)
    new = np.ones(len(rows), bool)
    new[1:] = (rows[1:] != rows[:-1]) | (bucket[1:] != bucket[:-1])
    rest = ((scaled[new] & U(0xFFFFFFFF)) << U(32)) | (hashes[new] & U(0xFFFFFFFF))
    top = rest >> U(11)
    bits = np.frexp(top.astype(np.float64))[1].astype(np.int64)
    shift = bits - 1 - MANTISSA
    low = np.where(shift >= 0, top >> np.maximum(shift, 0).astype(U), top << np.maximum(-shift, 0).astype(U)) & U((1 << MANTISSA) - 1)
    zeros = np.minimum(53 - bits, 62)
    out[rows[new], bucket[new]] = (zeros.astype(np.uint16) << MANTISSA) | low.astype(np.uint16)
    return out


def band_keys(registers: np.ndarray) -> np.ndarray:
    """A key for each text and band. Empty registers take the value of the first full one in an order fixed for each."""
    full = registers.copy()
    for probe in _PROBES:
        rows = np.flatnonzero((full == EMPTY).any(1))
        if not len(rows):
            break
        part = full[rows]
        full[rows] = np.where(part == EMPTY, registers[rows][:, probe], part)
    rows = np.flatnonzero((full == EMPTY).any(1))
    for step in range(1, REGISTERS):
        if not len(rows):
            break
        part = full[rows]
        full[rows] = np.where(part == EMPTY, np.roll(registers[rows], -step, 1), part)
        rows = rows[(full[rows] == EMPTY).any(1)]
    lanes = full.reshape(len(full), BANDS, BAND).astype(U)
    key = np.zeros((len(full), BANDS), U)
    for i in range(BAND):
        key = (key ^ (key >> U(31))) * _C[4] + lanes[:, :, i] * _C[5]
    return mix(key + np.arange(BANDS, dtype=U) * _C[6])


def estimate(a: np.ndarray, b: np.ndarray, size_a: np.ndarray, size_b: np.ndarray) -> np.ndarray:
    """Jaccard estimate of pairs of signatures, without the registers that agree by chance."""
    used = (a != EMPTY) | (b != EMPTY)
    n = np.maximum(used.sum(1), 1)
    share = ((a == b) & used).sum(1) / n
    # Chance that the least hashes of two other sets have as many leading zeros, and then the same bits.
    edge = 2.0 ** -np.arange(64)
    tail_a = (1 - edge) ** np.maximum(size_a / REGISTERS, 1)[:, None]
    tail_b = (1 - edge) ** np.maximum(size_b / REGISTERS, 1)[:, None]
    chance = ((tail_a[:, 1:] - tail_a[:, :-1]) * (tail_b[:, 1:] - tail_b[:, :-1])).sum(1) / (1 << MANTISSA)
    return (share - chance) / (1 - chance)


def likely(a: np.ndarray, b: np.ndarray, size_a: np.ndarray, size_b: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Estimates of pairs, and how far below the threshold an estimate may lie and still go on to the full sets.

    Of a union of few more elements than registers in use, nearly all were seen: the slack shrinks with the share unseen.
    """
    used = np.maximum(((a != EMPTY) | (b != EMPTY)).sum(1), 1)
    union = (size_a + size_b) / (1 + threshold)
    unseen = np.clip(1 - used / np.maximum(union, 1), 0, 1)
    slack = MARGIN * np.sqrt(threshold * (1 - threshold) / used * unseen) + 2 / used
    return estimate(a, b, size_a, size_b), slack


def linked(own: np.ndarray, mine: np.ndarray, percent: int) -> bool:
    """Whether two sorted sets have ``percent`` of their union in common."""
    if not len(own) or not len(mine):
        return False
    at = np.searchsorted(own, mine)
    at[at == len(own)] = 0
    both = int((own[at] == mine).sum())
    return 100 * both >= percent * (len(own) + len(mine) - both)


def _names(schema: str) -> list[str]:
    return [x.split()[0] for x in schema.split(", ")]


SKETCH = "doc_id long, n_shingles long, low long, high long, bands array<long>"
FULL = "doc_id long, n_shingles long, registers binary, text string"


def _sketch(words: int):
    """Texts to the size of their sets, two independent sums that tell sets apart, and band keys."""

    def task(batches):
        shared: dict = {}
        for part in pieces(batches, "text", CHUNK):
            data, at = flat(part.column(1))
            n = len(at) - 1
            rows, hashes = shingles(data, at, words, shared)
            sizes = np.bincount(rows, minlength=n)
            begin = np.cumsum(sizes) - sizes
            sums = []
            for seed in (_C[1], _C[7]):
                total = np.concatenate([[U(0)], np.cumsum(mix(hashes * seed + seed), dtype=U)])
                sums.append(pa.array((total[begin + sizes] - total[begin]).view(np.int64)))
            has = sizes > 0
            keys = band_keys(signatures(rows, hashes, n)[has]).reshape(-1).view(np.int64)
            bound = np.concatenate([[0], np.cumsum(np.where(has, BANDS, 0))]).astype(np.int32)
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(sizes.astype(np.int64)), *sums, pa.ListArray.from_arrays(pa.array(bound), pa.array(keys))], _names(SKETCH))

    return task


def _full(words: int):
    def task(batches):
        shared: dict = {}
        for part in pieces(batches, "text", CHUNK):
            data, at = flat(part.column(1))
            n = len(at) - 1
            rows, hashes = shingles(data, at, words, shared)
            registers = signatures(rows, hashes, n)
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(np.bincount(rows, minlength=n).astype(np.int64)), pa.array([r.tobytes() for r in registers], pa.binary()), part.column(1)], _names(FULL))

    return task


def _estimated(percent: int):
    """Pairs with the signatures of both to those that may reach the threshold."""

    def task(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            size = [batch.column(i).to_numpy(zero_copy_only=False).astype(np.float64) for i in (2, 3)]
            registers = [np.frombuffer(b"".join(batch.column(i).to_pylist()), np.uint16).reshape(-1, REGISTERS) for i in (4, 5)]
            guess, slack = likely(*registers, *size, percent / 100)
            near = (guess >= percent / 100 - slack) & (100 * np.minimum(*size) >= percent * np.maximum(*size))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["a", "b"]).filter(pa.array(near))

    return task


def _verified(words: int, percent: int):
    """Texts in order of their centre, the centre's own first, to the links with it: full sets are compared."""

    def task(batches):
        shared: dict = {}
        centre, own = None, []
        for part in pieces(batches, "text", CHUNK):
            data, at = flat(part.column(2))
            rows, hashes = shingles(data, at, words, shared)
            cut = np.searchsorted(rows, np.arange(len(at)))
            links = []
            for i, (x, y) in enumerate(zip(longs(part.column(0)).tolist(), longs(part.column(1)).tolist(), strict=True)):
                mine = hashes[cut[i] : cut[i + 1]]
                if x != centre:
                    centre, own = x, []
                if x == y:
                    own.append(mine)  # more than one only if texts share the id
                elif any(linked(o, mine, percent) for o in own):
                    links.append((x, y))
            yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in links], pa.int64()), pa.array([y for _, y in links], pa.int64())], ["a", "b"])

    return task


def components(links: DataFrame, name: str = "components") -> DataFrame:
    """doc_id and component (the smallest id reachable) of every id in the links (a, b).

    Two steps alternate until only stars are left: each id's larger neighbours go to the smallest of its neighbourhood, then
    its smaller ones do. Both keep components and shorten paths, so the rounds follow the logarithm of the longest path.
    """

    def stars(edges: DataFrame) -> bool:
        """No centre is a leaf, and no leaf has two centres."""
        ends = edges.select(F.col("a").alias("v"), F.lit(0).alias("leaf")).unionByName(edges.select(F.col("b").alias("v"), F.lit(1).alias("leaf")))
        seen = ends.groupBy("v").agg(F.sum("leaf").alias("leaf"), F.min("leaf").alias("least"))
        return seen.filter("leaf > 1 OR (leaf = 1 AND least = 0)").isEmpty()

    edges = stored(links.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).filter("a < b").distinct(), name)
    while not stars(edges):
        both = edges.select(F.col("a").alias("v"), F.col("b").alias("w")).unionByName(edges.select(F.col("b").alias("v"), F.col("a").alias("w")))
        low = both.groupBy("v").agg(F.min(F.least("v", "w")).alias("low"))
        large = edges.join(low, edges["a"] == low["v"]).select(F.col("low").alias("a"), "b")
        small = large.groupBy(F.col("b").alias("v")).agg(F.min("a").alias("low"))
        moved = large.join(small, large["b"] == small["v"]).select(F.col("low").alias("a"), F.when(F.col("a") == F.col("low"), F.col("b")).otherwise(F.col("a")).alias("b"))
        edges = stored(moved.distinct(), name)
    return edges.select(F.col("b").alias("doc_id"), F.col("a").alias("component"))


def find_components(docs: DataFrame, members: DataFrame, words: int, percent: int) -> DataFrame:
    """doc_id and component of the ids that links join. ``members``: band, doc_id and size of the bands of two or more."""
    spark = docs.sparkSession
    ids = members.select("doc_id").distinct()
    full = stored(docs.join(ids.hint("shuffle_hash"), "doc_id", "left_semi").mapInArrow(lean(_full(words)), FULL), "band-texts")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))

    def links(pairs: DataFrame) -> DataFrame:
        """Of pairs (a, b) those that are linked."""
        one = full.select(F.col("doc_id").alias("a"), F.col("n_shingles").alias("n_a"), F.col("registers").alias("r_a"))
        two = full.select(F.col("doc_id").alias("b"), F.col("n_shingles").alias("n_b"), F.col("registers").alias("r_b"))
        both = pairs.distinct().join(one, "a").join(two, "b").select("a", "b", "n_a", "n_b", "r_a", "r_b")
        near = stored(both.mapInArrow(lean(_estimated(percent)), "a long, b long"), "near-pairs")
        # A centre with many others is compared in several tasks, its own text in each.
        slices = near.groupBy("a").agg(F.ceil(F.count("*") / SLICE).cast("int").alias("slices"))
        others = near.join(slices, "a").select("a", "b", F.pmod(F.xxhash64("b"), "slices").cast("int").alias("slice"))
        own = slices.select("a", F.col("a").alias("b"), F.explode(F.sequence(F.lit(0), F.col("slices") - 1)).alias("slice"))
        texts = others.unionByName(own).join(full.select(F.col("doc_id").alias("b"), "text"), "b")
        texts = texts.withColumn("other", F.col("a") != F.col("b"))
        dealt = texts.repartition(parts, "a", "slice").sortWithinPartitions("a", "slice", "other").select("a", "b", "text")
        return stored(dealt.mapInArrow(lean(_verified(words, percent)), "a long, b long"), "links")

    # First all pairs of small bands, and of each document with the least id in one large band, the largest it is in.
    small = members.filter(F.col("size") <= SMALL)
    pairs = small.alias("x").join(small.alias("y"), "band").filter("x.doc_id < y.doc_id").select(F.col("x.doc_id").alias("a"), F.col("y.doc_id").alias("b"))
    large = members.filter(F.col("size") > SMALL).groupBy("doc_id").agg(F.max(F.struct("size", "band"))["band"].alias("band"), F.collect_list("band").alias("bands"))
    large = stored(large, "large-bands")
    centres = large.groupBy("band").agg(F.min("doc_id").alias("centre"))
    offered = large.select("band", "doc_id").join(centres, "band").filter("doc_id != centre")
    found = links(pairs.unionByName(offered.select(F.col("centre").alias("a"), F.col("doc_id").alias("b"))))
    joined = components(found)
    # Bands that hold several components. What is in a band's largest component is not needed row by row.
    docs = stored(large.join(joined, "doc_id", "left").select("doc_id", F.coalesce("component", "doc_id").alias("component"), "bands"), "large-documents")
    named = docs.select(F.explode("bands").alias("band"), "doc_id", "component")
    inside = named.groupBy("band", "component").agg(F.count("*").alias("size"))
    several = inside.groupBy("band").agg(F.count("*").alias("components"), F.max(F.struct("size", "component"))["component"].alias("largest")).filter("components > 1")
    rest = stored(named.join(several.select("band", "largest"), "band").filter("component != largest"), "open-rest")
    if rest.isEmpty():
        return joined
    return components(found.unionByName(_settle(full, docs.select("doc_id", "component"), rest, words, percent)))


def _settle(full: DataFrame, docs: DataFrame, rest: DataFrame, words: int, percent: int) -> DataFrame:
    """Links between the components that meet in open bands: enough of them to join what belongs together.

    ``docs`` names the component of each document, ``rest`` (band, doc_id, component, largest) has those that are not in the
    largest one of a band. In each band every other component is held against the largest, and the others against each other.
    The first is done once for each pair of components: the larger one's documents in slices, the other's beside every slice.
    The second is done band by band, again in slices. Slices are compared in memory; only links that join something come out.
    """
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def sliced(kind: int, one: DataFrame, two: DataFrame) -> DataFrame:
        """Rows of the first side by slice of its group, those of the second in every slice."""
        slices = one.groupBy("group").agg(F.ceil(F.count("*") / SLICE).cast("int").alias("slices"))
        first = one.join(slices, "group").select("group", F.pmod(F.xxhash64("doc_id"), "slices").cast("int").alias("slice"), F.lit(0).alias("side"), "doc_id", "component")
        second = two.join(slices, "group").select("group", F.explode(F.sequence(F.lit(0), F.col("slices") - 1)).alias("slice"), F.lit(1).alias("side"), "doc_id", "component")
        return first.unionByName(second).withColumn("kind", F.lit(kind))

    tests = rest.select(F.col("largest").alias("group"), "component").distinct()
    one = docs.join(tests.select(F.col("group").alias("component")).distinct(), "component", "left_semi").select(F.col("component").alias("group"), "doc_id", "component")
    two = tests.join(docs, "component").select("group", "doc_id", "component")
    several = rest.groupBy("band").agg(F.min("component").alias("least"), F.max("component").alias("most")).filter("least != most")
    among = rest.join(several.select("band"), "band", "left_semi").select(F.col("band").alias("group"), "doc_id", "component")
    rows = sliced(0, one, two).unionByName(sliced(1, among, among))
    key = ["kind", "group", "slice"]
    rows = rows.join(full.select("doc_id", "text"), "doc_id").repartition(parts, *key).sortWithinPartitions(*key, "side")
    return stored(rows.select(*key, "side", "doc_id", "component", "text").mapInArrow(lean(_settled(words, percent)), "a long, b long"), "links")


def _settled(words: int, percent: int):
    """Rows in order of slice, first sides before second, to the links that join different components in a slice."""

    def compare(own: list, others: list, roots: dict):
        """Links of ``others`` with ``own``; each side has ids, components, sets and registers."""

        def root(x):
            while roots.setdefault(x, x) != x:
                x = roots[x]
            return x

        sizes = np.array([len(x[2]) for x in own], np.float64)
        registers = np.array([x[3] for x in own])
        for doc, component, mine, register in others:
            n = float(len(mine))
            near = 100 * np.minimum(sizes, n) >= percent * np.maximum(sizes, n)
            rows = np.flatnonzero(near)
            if not len(rows) or not n:
                continue
            guess, slack = likely(registers[rows], register[None, :], sizes[rows], np.full(len(rows), n), percent / 100)
            rows, guess = rows[guess >= percent / 100 - slack], guess[guess >= percent / 100 - slack]
            for i in rows[np.argsort(-guess, kind="stable")].tolist():
                other, theirs, held, _ = own[i]
                x, y = root(component), root(theirs)
                if x != y and linked(held, mine, percent):
                    roots[max(x, y)] = min(x, y)
                    yield other, doc

    def task(batches):
        shared: dict = {}
        key, own, others, roots = None, [], [], {}
        for part in pieces(batches, "text", CHUNK):
            data, at = flat(part.column(6))
            rows, hashes = shingles(data, at, words, shared)
            registers = signatures(rows, hashes, len(at) - 1)
            cut = np.searchsorted(rows, np.arange(len(at)))
            links = []
            columns = [part.column(i).to_pylist() for i in range(6)]
            for i, (kind, group, piece, side, doc, component) in enumerate(zip(*columns, strict=True)):
                if (kind, group, piece) != key:
                    links += compare(own, others, roots)
                    key, own, others, roots = (kind, group, piece), [], [], {}
                (others if side else own).append((doc, component, hashes[cut[i] : cut[i + 1]].copy(), registers[i].copy()))
                if len(others) >= 256:
                    links += compare(own, others, roots)
                    others = []
            yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in links], pa.int64()), pa.array([y for _, y in links], pa.int64())], ["a", "b"])
        links = list(compare(own, others, roots))
        yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in links], pa.int64()), pa.array([y for _, y in links], pa.int64())], ["a", "b"])

    return task


def near_duplicates(documents: DataFrame, words: int = 5, percent: int = 80, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Groups of documents whose sets of ``words``-word shingles have ``percent`` of their union in common.

    Returns doc_id, n_shingles (size of the set), component_id (smallest id reachable over links, the own one included) and
    kept (doc_id = component_id), a row for each row of the input. A null, empty or blank text has no shingles and no links.
    Rows that share an id are one document with several texts: a link of any of them counts. A row without an id is linked
    with nothing and kept. Other columns are not read.
    """
    spark = documents.sparkSession
    ship(spark)
    docs = documents.select(column(documents, doc_id, "doc_id", "bigint"), column(documents, text, "text", "string"))
    sketch = stored(docs.mapInArrow(lean(_sketch(words)), SKETCH), "sketch")
    full = sketch.filter(F.col("doc_id").isNotNull() & (F.col("n_shingles") > 0))
    key = ["n_shingles", "low", "high"]
    # Copies of one text may be most rows: they are counted in slices, and find their class by slice.
    parts = F.lit(int(spark.conf.get("spark.sql.shuffle.partitions")))
    sliced = full.select("doc_id", *key, F.pmod(F.xxhash64("doc_id"), parts).cast("int").alias("slice"))
    slices = sliced.groupBy(*key, "slice").agg(F.min("doc_id").alias("least"))
    classes = slices.groupBy(*key).agg(F.min("least").alias("class"))
    told = slices.drop("least").join(classes, key)
    alone = sketch.filter(F.col("doc_id").isNull() | (F.col("n_shingles") <= 0)).select("doc_id", "n_shingles", F.lit(None).cast("long").alias("class"))
    classed = stored(sliced.join(told, [*key, "slice"]).select("doc_id", "n_shingles", "class").unionByName(alone), "classes")
    bands = full.join(classes.select(F.col("class").alias("doc_id")).distinct().hint("shuffle_hash"), "doc_id", "left_semi")
    bands = stored(bands.select("doc_id", F.explode("bands").alias("band")).distinct(), "bands")
    sizes = bands.groupBy("band").agg(F.count("*").alias("size")).filter("size > 1")
    members = stored(bands.join(sizes, "band").select("band", "doc_id", "size"), "band-members")
    joined = find_components(docs.filter(F.col("doc_id").isNotNull()), members, words, percent)
    # Classes of one id belong together.
    first = classed.filter(F.col("class").isNotNull()).groupBy("doc_id").agg(F.min("class").alias("first"), F.max("class").alias("last")).filter("first != last")
    shared = classed.join(first.select("doc_id", "first"), "doc_id").select(F.col("first").alias("a"), F.col("class").alias("b")).filter("a != b")
    shared = stored(shared, "shared-ids")
    if not shared.isEmpty():
        joined = components(shared.unionByName(joined.select(F.col("component").alias("a"), F.col("doc_id").alias("b"))))
    parts = joined.select(F.col("doc_id").alias("class"), "component")
    named = classed.filter(F.col("class").isNotNull()).join(parts, "class", "left").select("doc_id", "n_shingles", F.coalesce("component", "class").alias("component_id"))
    out = named.unionByName(classed.filter(F.col("class").isNull()).select("doc_id", "n_shingles", F.col("doc_id").alias("component_id")))
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))
