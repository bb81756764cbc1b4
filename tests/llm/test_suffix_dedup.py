"""Repeated strings against brute force over every 50-byte string."""

import hashlib
import random

import pytest

from cartolex.llm.suffix_dedup import Family, remove_repeats

SCHEMA = "doc_id long, text string, bucket string"


def brute(rows, length=50):
    first = {}
    for d, t, _ in rows:
        if d is None:
            continue
        b = (t or "").encode()
        for i in range(len(b) - length + 1):
            s = b[i : i + length]
            first[s] = min(first.get(s, d), d)
    out = []
    for d, t, _ in rows:
        b = (t or "").encode()
        gone = bytearray(len(b))
        for i in range(len(b) - length + 1) if d is not None else ():
            if first[b[i : i + length]] < d:
                gone[i : i + length] = b"\1" * length
        kept = bytes(x for x, g in zip(b, gone, strict=True) if not g)
        spans = sum(1 for i, g in enumerate(gone) if g and (i == 0 or not gone[i - 1]))
        out.append((d, len(b), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=repr)


def run(spark, rows, **more):
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    got = remove_repeats(df, **more).collect()
    return sorted(((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, hashlib.sha256(bytes(r.kept)).hexdigest()) for r in got), key=repr)


def corpus(seed):
    rnd = random.Random(seed)
    word = lambda: "".join(rnd.choice(["an", "é", "the", "o", "ß", "ing", "x"]) for _ in range(rnd.randint(1, 4)))
    prose = lambda n: " ".join(word() for _ in range(n))
    shared = [prose(rnd.randint(8, 40)) for _ in range(6)]
    rows = []
    for d in rnd.sample(range(10_000), 120):
        parts = [rnd.choice([prose(rnd.randint(0, 60)), rnd.choice(shared), rnd.choice(shared)[rnd.randint(0, 20) :]]) for _ in range(rnd.randint(0, 5))]
        rows.append((d, rnd.choice([" ", "", "--"]).join(parts), "b"))
    base = prose(200)
    for d in range(20_000, 20_040):  # near copies
        t = list(base)
        for _ in range(rnd.randint(0, 4)):
            t[rnd.randrange(len(t))] = "#"
        rows.append((d, "".join(t), None))
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_against_every_string(spark, seed):
    rows = corpus(seed)
    assert run(spark, rows) == brute(rows)


def test_odd_rows(spark):
    rows = [
        (1, "a" * 3000, "x"), (2, "b" + "a" * 49, "x"), (3, "b" + "a" * 50, "x"), (4, None, None), (5, "", "x"), (None, "a" * 100, "x"),
        (6, "ab" * 400, "x"), (6, "ab" * 300, "x"), (7, "ba" * 30, "x"), (8, "z" * 49, "x"), (9, "z" * 49, "x"), (10, "short", "x"),
    ]
    assert run(spark, rows) == brute(rows)


def test_hot_anchor(spark):
    # One sentence in other surroundings each time: more blocks with one anchor than a batch deals out by anchor.
    rnd = random.Random(3)
    noise = lambda n: "".join(rnd.choice("abcdefghij ") for _ in range(n))
    rows = [(d, noise(30) + "the quick brown fox jumps over it " + noise(30), "x") for d in range(200)]
    rows += [(1000 + d, rows[d][1][5:], "x") for d in range(50)]
    assert run(spark, rows) == brute(rows)


def test_other_length(spark):
    rows = corpus(5)
    assert run(spark, rows, length=32) == brute(rows, 32)


def test_empty_table(spark):
    assert run(spark, []) == []


def test_levels_grow_geometrically():
    import numpy as np

    family = Family()
    for i in range(100):
        x = np.arange(i * 10, i * 10 + 10).astype(np.uint64)
        family.add(x, x, np.full(10, i))
    assert len(family.levels) <= 8 and sum(len(x[2]) for x in family.levels) == 1000
