"""Benchmark windows in texts against a search word by word."""

import random
import re

import pytest

from cartolex.llm import decontaminate as d

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
SCHEMA = "doc_id long, text string, items string, n_words string"


def words(text):
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute(docs, items, window):
    out = []
    for i, t, *_ in docs:
        own = words(t)
        hit, met = [False] * len(own), set()
        for item, text in items:
            w = words(text)
            size = min(len(w), window)
            for k in range(len(w) - size + 1 if w else 0):
                for s in range(len(own) - size + 1):
                    if own[s : s + size] == w[k : k + size]:
                        hit[s : s + size] = [True] * size
                        met.add(-1 if item is None else item)
        out.append((i, len(own), sum(hit), sorted(met)))
    return sorted(out, key=repr)


def corpus(seed):
    rnd = random.Random(seed)
    vocabulary = ["a", "The", "größe", "ñ", "x1", "42", "don", "t", "漢", "İ", "ing"]
    prose = lambda n: "".join(rnd.choice(vocabulary) + rnd.choice([" ", ", ", "\n", "--", "'"]) for _ in range(n))
    items = [(k, prose(rnd.randint(4, 14))) for k in range(25)] + [(None, prose(6)), (3, "one more under an id"), (90, None), (91, ""), (92, "!!"), (93, "Rare")]
    docs = []
    for k in range(80):
        parts = [prose(rnd.randint(0, 20)), rnd.choice(items)[1] or "", prose(rnd.randint(0, 5)), (rnd.choice(items)[1] or "")[rnd.randint(0, 9) :]]
        docs.append((k, rnd.choice([" ", ".", ""]).join(parts), "x", None))
    return docs + [(1, "rare", "x", None), (None, "a rare bird", "x", None), (200, None, None, None), (201, "", "x", None), (202, "rare " * 5000, "x", None)], items


@pytest.mark.parametrize(("seed", "window", "limit"), [(1, 5, d.LARGEST), (2, 10, d.LARGEST), (3, 5, 200)])
def test_against_search(spark, seed, window, limit):
    docs, items = corpus(seed)
    got = d.find_leaks(spark.createDataFrame(docs, SCHEMA).repartition(3), spark.createDataFrame(items, "item_id long, text string"), window, limit)
    assert sorted(((r.doc_id, r.n_words, r.n_hit, r["items"]) for r in got.collect()), key=repr) == brute(docs, items, window)


def test_cut(spark):
    item = "One two three, four five six seven eight nine ten eleven"
    rows = [(1, f"Ä before. {item}! After", 5), (2, item.upper(), 6), (3, "clean text", 10), (4, None, None), (5, "", 0)]
    out = d.cut_leaks(spark.createDataFrame(rows, "doc_id long, text string, n_chars long"), spark.createDataFrame([(1, item)], "item_id long, text string"))
    got = {r.doc_id: (r.text, r.n_chars) for r in out.collect()}
    assert out.columns == ["doc_id", "text", "n_chars"]
    assert got == {1: ("Ä before. ! After", 17), 3: ("clean text", 10), 4: (None, None), 5: ("", 0)}


def test_empty_tables(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    items = spark.createDataFrame([(1, "some words here")], "item_id long, text string")
    assert d.find_leaks(none, items).collect() == []
    got = d.find_leaks(spark.createDataFrame([(1, "some words here")], "doc_id long, text string"), items.limit(0)).collect()
    assert [(r.n_words, r.n_hit, r["items"]) for r in got] == [(3, 0, [])]


def test_parts_are_collected_one_at_a_time(spark):
    items = [(i, f"item {i} " * 20) for i in range(30)]
    parts = d.parts_of(spark.createDataFrame(items, "item_id long, text string"), 1000)
    held, more = next(parts)
    rest = list(parts)
    assert more and len(held) < 30 and [m for _, m in rest] == [True] * (len(rest) - 1) + [False]
    assert sorted(tuple(r) for rows, _ in [(held, more), *rest] for r in rows) == items
