"""Quality grades by ordinal regression over hashed text.

A grade is one of an ordered few. One score, the sum of the weights of a text's hashed features, is shared by all grades;
ordered thresholds cut it: the chance of a grade of at most k is sigmoid(threshold k - score). So a text has an expected
grade and a chance of reaching any grade, by which texts are selected.

Features are words, beginnings of words (which stand for inflected and compound forms) and bins of a few shares of the text.
The model is fitted on a bounded sample of the labelled rows, picked by hash; everything else reads all rows and whole texts.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cartolex.llm.common import U, Spans, column, constants, flat, lean, pieces, ship
from cartolex.llm.decontaminate import WORD
from cartolex.llm.near_dedup import LOWER, SPACE

BITS = 22
#: Bytes of a word's beginnings.
BEGINS = (4, 5, 6)
#: A feature of fewer texts of the sample has no weight.
RARE = 5
#: Labelled rows that a fit reads at most.
SAMPLE = 16_000
CHUNK = 1 << 20
_CODES = constants(31, 256)
_C = constants(37, 12)
_UPPER, _DIGIT, _SIGN = (np.zeros(256, bool) for _ in range(3))
_UPPER[65:91] = True
_DIGIT[48:58] = True
_SIGN[33:48] = _SIGN[58:65] = _SIGN[91:97] = _SIGN[123:127] = True
SCORED = "expected_grade double, chance double"


def _runs(kind: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Begin and end of each run of a kind of bytes within one text."""
    begins, ends = kind.copy(), kind.copy()
    begins[1:] &= ~kind[:-1]
    ends[:-1] &= ~kind[1:]
    inner = at[(at > 0) & (at < len(kind))]
    begins[inner], ends[inner - 1] = kind[inner], kind[inner - 1]
    return np.flatnonzero(begins), np.flatnonzero(ends) + 1


def features(data: np.ndarray, at: np.ndarray, shared: dict) -> tuple[np.ndarray, np.ndarray]:
    """Row and place of each distinct feature of each text, in order. Every text has some, an empty one too."""
    n = len(at) - 1
    low = LOWER[data]
    spans = Spans(low, _CODES, shared)
    # Words without signs, and their beginnings.
    first, last = _runs(WORD[low], at)
    words = np.searchsorted(at, first, "right") - 1
    hashes = [spans.of(first, last), *(spans.of(first, np.minimum(first + k, last)) * _C[0] for k in BEGINS)]
    # What blanks part, for the shares.
    first, last = _runs(~SPACE[low], at)
    row = np.searchsorted(at, first, "right") - 1
    whole = spans.of(first, last)
    counts = np.bincount(row, minlength=n).astype(np.float64)
    size = np.maximum(np.diff(at), 1).astype(np.float64)

    def share(kind: np.ndarray) -> np.ndarray:
        total = np.concatenate([[0], np.cumsum(kind[data])])
        return (total[at[1:]] - total[at[:-1]]) / size

    def distinct(values: np.ndarray) -> np.ndarray:
        order = np.lexsort((values, row))
        r, v = row[order], values[order]
        new = np.ones(len(r), bool)
        new[1:] = (r[1:] != r[:-1]) | (v[1:] != v[:-1])
        return np.bincount(r[new], minlength=n)

    last_byte = data[last - 1] if len(last) else data[:0]
    style = [
        np.floor(np.log2(counts + 1)),
        np.floor(20 * share(_UPPER)),
        np.floor(40 * share(_SIGN)),
        np.floor(40 * share(_DIGIT)),
        np.floor(np.minimum(15, 2 * (size / np.maximum(counts, 1)))),
        np.floor(10 * distinct(whole) / np.maximum(counts, 1)),
        np.floor(10 * np.bincount(row[_SIGN[last_byte]], minlength=n) / np.maximum(counts, 1)),
        np.floor(10 * np.bincount(row[1:][(row[1:] == row[:-1]) & (whole[1:] == whole[:-1])], minlength=n) / np.maximum(counts, 1)) if len(row) else np.zeros(n),
    ]
    styles = [(x.astype(np.int64).astype(U) + U(1000 * (i + 1))) * _C[1 + i] for i, x in enumerate(style)]
    rows = np.concatenate([*[words] * len(hashes), *[np.arange(n)] * len(styles)])
    places = (np.concatenate([*hashes, *styles]) * _C[11] >> U(64 - BITS)).astype(np.int64)
    key = np.unique(rows << BITS | places)
    return key >> BITS, key & ((1 << BITS) - 1)


class Model:
    """Weights of the features and thresholds between the grades."""

    def __init__(self, weights: np.ndarray, thresholds: np.ndarray):
        self.weights, self.thresholds = weights, thresholds

    def __getstate__(self):
        places = np.flatnonzero(self.weights)
        return places, self.weights[places], self.thresholds

    def __setstate__(self, state):
        self.weights, self.thresholds = np.zeros(1 << BITS), state[2]
        self.weights[state[0]] = state[1]

    def tails(self, scores: np.ndarray) -> np.ndarray:
        """Chance of each text to pass each threshold."""
        return 1 / (1 + np.exp(np.clip(self.thresholds[None, :] - scores[:, None], -60, 60)))

    def scores(self, rows: np.ndarray, places: np.ndarray, n: int) -> np.ndarray:
        return np.bincount(rows, self.weights[places], minlength=n)


def fit(texts: list[tuple[np.ndarray, int]], grades: int, rounds: int = 12, rate: float = 0.5, sparse: float = 10.0, praise: float = 100.0, power: float = 0.5, rare: float = 0.002) -> Model:
    """Fit on (places of the features, grade) by steps over small batches (FTRL-proximal).

    Each weight's step shrinks with its history, and ``sparse`` keeps at zero what does not pay: most words say nothing. To
    raise a score takes more evidence (``praise``), else the many common words of a long text outweigh a few bad ones. Features
    of less than the share ``rare`` of the texts have no weight; ``power`` says how much the rarer grades count for more.
    """
    rng = np.random.default_rng(1)
    seen = np.zeros(1 << BITS, np.int32)
    for k in range(0, len(texts), 500):
        np.add.at(seen, np.concatenate([p for p, _ in texts[k : k + 500]]), 1)
    # Only these features are fitted, under numbers of their own.
    fitted = seen >= max(RARE, rare * len(texts))
    often = np.flatnonzero(fitted).astype(np.int32)
    # Look up in two tables: a search for each text would leave the worker's memory in pieces.
    number = (np.cumsum(fitted) - 1).astype(np.int32)
    texts = [(number[p[fitted[p]]], g) for p, g in texts]
    del seen, number, fitted
    weights, history, pull = (np.zeros(len(often)) for _ in range(3))
    counts = np.bincount([g for _, g in texts], minlength=grades) + 1.0
    share = np.cumsum(counts)[:-1] / counts.sum()
    base = np.log(share / (1 - share))
    # The first threshold and the logarithms of the steps between: any values give ordered thresholds.
    free = np.concatenate([base[:1], np.log(np.maximum(np.diff(base), 1e-3))])
    past = np.full(len(free), 1e-2)
    importance = (counts.sum() / (grades * counts)) ** power
    order = np.arange(len(texts))
    for _ in range(rounds):
        rng.shuffle(order)
        for some in np.array_split(order, max(1, len(order) // 16)):
            if not len(some):
                continue
            places = np.concatenate([texts[i][0] for i in some])
            rows = np.repeat(np.arange(len(some)), [len(texts[i][0]) for i in some])
            grade = np.array([texts[i][1] for i in some])
            cuts = np.cumsum(np.concatenate([free[:1], np.exp(free[1:])]))
            score = np.bincount(rows, weights[places], minlength=len(some))
            below = 1 / (1 + np.exp(np.clip(score[:, None] - cuts[None, :], -60, 60)))
            edge = np.concatenate([np.zeros((len(some), 1)), below, np.ones((len(some), 1))], 1)
            low, high = edge[np.arange(len(some)), grade], edge[np.arange(len(some)), grade + 1]
            chance = np.maximum(high - low, 1e-9)
            weight = importance[grade]
            # Slopes of -log chance by score and by the two thresholds around the grade.
            d_low, d_high = low * (1 - low), high * (1 - high)
            by_score = weight * (d_high - d_low) / chance
            by_cut = np.zeros(len(cuts))
            np.add.at(by_cut, np.minimum(grade, len(cuts) - 1), np.where(grade < len(cuts), -weight * d_high / chance, 0))
            np.add.at(by_cut, np.maximum(grade - 1, 0), np.where(grade > 0, weight * d_low / chance, 0))
            met, at = np.unique(places, return_inverse=True)
            g = np.bincount(at, by_score[rows], minlength=len(met))
            step = (np.sqrt(history[met] + g * g) - np.sqrt(history[met])) / rate
            pull[met] += g - step * weights[met]
            history[met] += g * g
            z = pull[met]
            held = np.where(z > 0, sparse, praise)
            weights[met] = np.where(np.abs(z) <= held, 0, (np.sign(z) * held - z) * rate / (1 + np.sqrt(history[met])))
            tail = np.cumsum(by_cut[::-1])[::-1]
            g = np.concatenate([tail[:1], tail[1:] * np.exp(free[1:])])
            past += g * g
            free -= 0.1 * g / np.sqrt(past)
    whole = np.zeros(1 << BITS)
    whole[often] = weights
    return Model(whole, np.cumsum(np.concatenate([free[:1], np.exp(free[1:])])))


def train(documents: DataFrame, graded: DataFrame, grades: int = 3, sample: int = SAMPLE, doc_id: str = "doc_id", text: str = "text") -> Model:
    """Fit on documents that have a grade (0 to grades - 1) in ``graded`` (doc_id, grade).

    Reads at most ``sample`` labelled rows, those of least hash of their id: the same rows in every run. Rows without id or
    grade, or with a grade out of range, are left out; an id with several grades has the least, one with several rows counts
    with the text of least digest.
    """
    ship(documents.sparkSession)
    given = graded.filter(F.col("doc_id").isNotNull() & F.col("grade").between(0, grades - 1)).groupBy("doc_id").agg(F.min("grade").cast("int").alias("grade"))
    given = given.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    docs = documents.select(column(documents, doc_id, "doc_id", "bigint"), column(documents, text, "text", "string"))
    # Rows that share an id are one before they meet in a task: the text of least digest, by a partial aggregate.
    labelled = docs.join(given.hint("shuffle_hash"), "doc_id").withColumn("digest", F.xxhash64("text"))
    rows = labelled.groupBy("doc_id").agg(F.min_by(F.struct("text", "grade"), F.struct("digest", "text")).alias("row")).select("row.text", "row.grade")

    def task(batches):
        shared: dict = {}
        for part in pieces(batches, "text", CHUNK):
            data, at = flat(part.column(0))
            row, places = features(data, at, shared)
            cut = np.searchsorted(row, np.arange(len(at)))
            places = places.astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array([places[a:b].tobytes() for a, b in zip(cut[:-1], cut[1:], strict=True)], pa.binary()), part.column(1)], ["places", "grade"])

    def fitted(batches):
        # In an order of their own, so that the model does not depend on how the rows came.
        held = sorted((p, g) for batch in batches for p, g in zip(*(c.to_pylist() for c in batch.columns), strict=True))
        model = fit([(np.frombuffer(p, np.int32), g) for p, g in held], grades)
        places = np.flatnonzero(model.weights)
        values = np.concatenate([model.thresholds, model.weights[places]])
        at = np.concatenate([-1 - np.arange(len(model.thresholds)), places])
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(values, pa.float64())], ["place", "value"])

    # One task, not the driver, holds the sample, whose size is bounded; the few weights that are not zero come back.
    sample_rows = rows.mapInArrow(lean(task), "places binary, grade int").repartition(1)
    found = sample_rows.mapInArrow(lean(fitted), "place long, value double").collect()
    if not found:
        return fit([], grades)
    weights, cuts = np.zeros(1 << BITS), {}
    for place, value in found:
        if place < 0:
            cuts[place] = value
        else:
            weights[place] = value
    return Model(weights, np.array([cuts[-1 - k] for k in range(grades - 1)]))


def score(documents: DataFrame, model: Model, least: int, text: str = "text") -> DataFrame:
    """The rows with expected_grade and chance: that of a grade of at least ``least``.

    A null text is judged as an empty one. All other columns stay; those named like the two are replaced.
    """
    spark = documents.sparkSession
    ship(spark)
    held = spark.sparkContext.broadcast(model)
    names = ["expected_grade", "chance"]
    keep = [c for c in documents.columns if c not in names]
    place = keep.index(text)
    frame = documents.select(*(F.col(f"`{c}`") for c in keep)).withColumn(text, F.col(f"`{text}`").cast("string"))

    def task(batches):
        shared: dict = {}
        for part in pieces(batches, text, CHUNK):
            data, at = flat(part.column(place))
            row, places = features(data, at, shared)
            tails = held.value.tails(held.value.scores(row, places, len(at) - 1))
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array(tails.sum(1)), pa.array(tails[:, least - 1])], [*keep, *names])

    return frame.mapInArrow(lean(task), frame.withColumns({c: F.lit(None).cast("double") for c in names}).schema)


def grades_of(labels: DataFrame) -> DataFrame:
    """Grades from labels of quality and toxicity: 0 poor, 1 well written but toxic, 2 good."""
    grade = F.when(F.col("quality") != 1, 0).when(F.col("toxic") == 1, 1).when(F.col("toxic") == 0, 2)
    return labels.select(F.col("doc_id").cast("long").alias("doc_id"), grade.alias("grade"))
