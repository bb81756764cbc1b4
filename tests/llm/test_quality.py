"""The ordinal model: held-out accuracy, ordered thresholds, the same result for the same rows."""

import random

import numpy as np
import pyarrow as pa
import pytest

from cartolex.llm import quality as q
from cartolex.llm.common import flat

SCHEMA = "doc_id long, text string, chance string, grade int"


def corpus(seed, n=1500):
    rnd = random.Random(seed)
    words = [f"{rnd.choice('bcdfg')}{rnd.choice('aeiou')}{rnd.choice('lmnrst')}{k}" for k in range(400)]
    rows, grades = [], []
    for d in range(n):
        grade = rnd.choice([0, 1, 2, 2, 2])
        own = [rnd.choice(words) for _ in range(rnd.randint(5, 120))]
        if grade == 1:
            own += ["Nasty," if rnd.random() < 0.5 else "awfulness"] * rnd.randint(1, 3)
            rnd.shuffle(own)
        text = " ".join(w + "!!" for w in own).upper() if grade == 0 else " ".join(own)
        rows.append((d, text, "x", None))
        grades.append((d, grade))
    return rows, grades


def test_held_out(spark):
    rows, grades = corpus(1)
    docs = spark.createDataFrame(rows, SCHEMA).repartition(3)
    model = q.train(docs, spark.createDataFrame(grades[:1000], "doc_id long, grade int"))
    assert (np.diff(model.thresholds) > 0).all()
    got = {r.doc_id: r for r in q.score(docs, model, 2).collect()}
    assert len(got) == len(rows)
    right = sum((got[d].chance >= 0.5) == (g == 2) for d, g in grades[1000:])
    assert right >= 0.95 * 500
    mean = [np.mean([got[d].expected_grade for d, g in grades[1000:] if g == k]) for k in range(3)]
    assert mean[0] < mean[1] < mean[2]


def test_order_of_rows_does_not_matter(spark):
    rows, grades = corpus(2, 300)
    given = spark.createDataFrame(grades, "doc_id long, grade int")
    a = q.train(spark.createDataFrame(rows, SCHEMA).repartition(2), given, sample=200)
    b = q.train(spark.createDataFrame(rows[::-1], SCHEMA).repartition(5), given.repartition(4), sample=200)
    assert np.array_equal(a.weights, b.weights) and np.array_equal(a.thresholds, b.thresholds)


def test_odd_rows(spark):
    rows, grades = corpus(3, 200)
    rows += [(None, "no id", "x", 1), (7, "again", "x", 1), (900, None, None, None), (901, "", "x", 1), (902, "w " * 50_000, "x", 1)]
    given = spark.createDataFrame([*grades, (None, 1), (7, 0), (7, 2), (8, None), (9, 5), (901, 0)], "doc_id long, grade int")
    docs = spark.createDataFrame(rows, SCHEMA)
    out = q.score(docs, q.train(docs, given), 2)
    assert out.columns == ["doc_id", "text", "grade", "expected_grade", "chance"]
    got = out.collect()
    assert len(got) == len(rows) and all(0 <= r.chance <= 1 for r in got)
    empty = {r.doc_id: r.chance for r in got if not r.text}
    assert empty[900] == empty[901]


def test_repeated_rows_of_an_id_are_one(spark):
    rows, grades = corpus(6, 200)
    graded = spark.createDataFrame(grades, "doc_id long, grade int")
    once, often = (q.train(spark.createDataFrame(r, SCHEMA), graded) for r in (rows, rows + rows[:1] * 300))
    assert np.array_equal(once.weights, often.weights) and np.array_equal(once.thresholds, often.thresholds)


def test_no_labels_and_no_documents(spark):
    rows, _ = corpus(4, 20)
    docs = spark.createDataFrame(rows, SCHEMA)
    none = spark.createDataFrame([], "doc_id long, grade int")
    assert q.score(docs, q.train(docs, none), 2).count() == 20
    assert q.score(docs.limit(0), q.train(docs.limit(0), none), 2).count() == 0


@pytest.mark.parametrize("power", [0.0, 0.5])
def test_slopes(power):
    # The fit lowers the loss on its own rows.
    rows, grades = corpus(5, 200)
    data, at = flat(pa.array([r[1] for r in rows]))
    row, places = q.features(data, at, {})
    cut = np.searchsorted(row, np.arange(len(at)))
    texts = [(places[a:b], g) for a, b, (_, g) in zip(cut[:-1], cut[1:], grades, strict=True)]

    def loss(model):
        tails = model.tails(model.scores(row, places, len(at) - 1))
        edge = np.concatenate([np.ones((len(tails), 1)), tails, np.zeros((len(tails), 1))], 1)
        g = np.array([g for _, g in texts])
        return -np.log(np.maximum(edge[np.arange(len(g)), g] - edge[np.arange(len(g)), g + 1], 1e-12)).mean()

    assert loss(q.fit(texts, 3, rounds=12, power=power)) < 0.6 * loss(q.fit(texts, 3, rounds=0))
