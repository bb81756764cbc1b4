"""Near-duplicate groups against all pairs, and the parts of the method."""

import random
import re

import numpy as np
import pytest

from cartolex.llm import near_dedup as n

SCHEMA = "doc_id long, text string, class string, component long"


def sets(text, words):
    own = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if len(own) < words:
        return {tuple(own)} if own else set()
    return {tuple(own[i : i + words]) for i in range(len(own) - words + 1)}


def brute(rows, words=5, percent=80):
    held = [(d, sets(t, words)) for d, t, *_ in rows]
    parent = {d: d for d, _ in held if d is not None}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, (a, s) in enumerate(held):
        for b, t in held[:i]:
            if a is not None and b is not None and s and 100 * len(s & t) >= percent * len(s | t):
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return sorted(((d, len(s), d if d is None else (find(d) if s else d), d is None or not s or find(d) == d) for d, s in held), key=repr)


def run(spark, rows, **more):
    got = n.near_duplicates(spark.createDataFrame(rows, SCHEMA).repartition(4), **more).collect()
    return sorted(((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in got), key=repr)


def corpus(seed):
    rnd = random.Random(seed)
    vocabulary = ["".join(rnd.choice("abcdefgé") for _ in range(rnd.randint(1, 6))) for _ in range(500)]
    prose = lambda k: [rnd.choice(vocabulary) for _ in range(k)]
    common = prose(12)
    rows, d = [], 0
    for _ in range(60):
        base = prose(rnd.choice([3, 8, 20, 60, 200, 600])) + (common if rnd.random() < 0.4 else [])
        for _ in range(rnd.choice([1, 1, 2, 5])):
            own = list(base)
            for _ in range(rnd.randint(0, max(1, len(own) // 40))):
                own[rnd.randrange(len(own))] = rnd.choice(vocabulary)
            rows.append((d, rnd.choice([" ", "\n", "  "]).join(own).replace("a", rnd.choice("aA")), "x", 0))
            d += 1
    rnd.shuffle(rows)
    return [(i * 7 % 1009, *r[1:]) for i, r in enumerate(rows)]


@pytest.mark.parametrize(("seed", "words"), [(1, 5), (2, 4)])
def test_against_all_pairs(spark, seed, words):
    rows = corpus(seed)
    assert run(spark, rows, words=words) == brute(rows, words)


def test_large_groups(spark):
    # Copies of two texts, each with its own changes, more than a band compares at once; and texts that share a passage.
    rnd = random.Random(5)
    prose = lambda k: [f"w{rnd.randrange(3000)}" for _ in range(k)]
    rows, passage = [], prose(25)
    for base in (prose(150), prose(40)):
        for _ in range(60):
            own = list(base)
            for _ in range(rnd.randint(0, 3)):
                own[rnd.randrange(len(own))] = f"new{rnd.randrange(10**6)}"
            rows.append((len(rows), " ".join(own), "x", 0))
    for _ in range(60):
        rows.append((len(rows), " ".join(passage + prose(rnd.randint(3, 12))), "x", 0))
    assert run(spark, rows) == brute(rows)


def test_common_text(spark):
    """Most of each text is shared by all, in two versions; a few are near copies of each other besides."""
    rnd = random.Random(8)
    prose = lambda k: [f"w{rnd.randrange(5000)}" for _ in range(k)]
    rows = []
    for common in (prose(120), prose(60)):
        for _ in range(90):
            own = prose(rnd.choice([16, 22, 60]))
            for _ in range(rnd.choice([1, 1, 1, 2, 3])):
                mine = list(own)
                mine[rnd.randrange(len(mine))] = f"new{rnd.randrange(10**6)}"
                rows.append((len(rows), " ".join(common + mine), "x", 0))
    assert run(spark, rows) == brute(rows)


def test_odd_rows(spark):
    rows = [
        (5, None, None, None), (6, "", "x", 0), (7, " \n\t ", "x", 0), (8, "one", "x", 0), (9, "ONE", "x", 0), (10, "one two", "x", 0), (None, "one", "x", 0), (None, None, "x", 0),
        (11, "a b c d e f g", "x", 0), (3, "a b c d e f g", "x", 0), (3, "quite another text with more words", "x", 0), (12, "quite another text with more words", "x", 0),
        (13, "w " * 5000, "x", 0), (14, "w " * 6, "x", 0), (15, "  x", "x", 0), (11, "a b c d e f g", "x", 0),
    ]
    assert run(spark, rows) == brute(rows)


def test_empty_table(spark):
    assert run(spark, []) == []


def test_components_of_a_path(spark):
    ids = list(range(300))
    random.Random(1).shuffle(ids)
    links = [(a, b) for a, b in zip(ids, ids[1:], strict=False) if (a + b) % 37]
    parent = {i: i for i in ids}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        x, y = find(a), find(b)
        parent[max(x, y)] = min(x, y)
    got = dict(n.components(spark.createDataFrame(links, "a long, b long")).collect())
    assert {i: got.get(i, i) for i in ids} == {i: find(i) for i in ids}


def test_estimate():
    rnd = np.random.default_rng(1)
    for size, share in ((2000, 0.8), (2000, 0.5), (300, 0.8), (50_000, 0.0)):
        both = int(size * share)
        pool = np.unique(rnd.integers(0, 2**63, 2 * size).astype(np.uint64))
        a, b = np.sort(pool[: both + (size - both) // 2]), np.sort(np.concatenate([pool[:both], pool[both + (size - both) // 2 : size]]))
        reg = [n.signatures(np.zeros(len(x), np.int64), n.mix(x)[np.argsort(n.mix(x))], 1) for x in (a, b)]
        guess = n.estimate(*reg, np.array([float(len(a))]), np.array([float(len(b))]))[0]
        assert abs(guess - both / size) < 0.09
