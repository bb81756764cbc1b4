"""Phrases against a plain count of every run of words."""

import random
import re
from collections import Counter

import numpy as np
import pytest

from cartolex.llm.collocations import collocations, parse, phrase_counts

SCHEMA = "doc_id long, text string, lang string, phrase string, n string, rank string, tail int"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def pieces(text):
    return [re.findall("[^ \t]+", p) for p in re.split("[.,;:!?\n\x0b\f\r]", (text or "").translate(LOWER))]


def counted(rows, longest):
    f, n = Counter(), Counter()
    for _, text, lang, *_ in rows:
        for words in pieces(text):
            n[lang or "und"] += len(words)
            for size in range(1, longest + 1):
                f.update((lang or "und", tuple(words[i : i + size])) for i in range(len(words) - size + 1))
    return f, n


def expected(rows, longest, least, covered, top):
    f, n = counted(rows, longest)
    found = {k: v for k, v in f.items() if len(k[1]) > 1 and v >= least}
    out = {}
    for (lang, words), a in found.items():
        inside = [v for (x, w), v in found.items() if x == lang and len(w) > len(words) and any(w[i : i + len(words)] == words for i in range(len(w)))]
        if any(100 * v >= covered * a for v in inside):
            continue
        cuts = [(1_000_000 * a * a // (f[lang, words[:k]] * f[lang, words[k:]]), k, f[lang, words[:k]], f[lang, words[k:]]) for k in range(1, len(words))]
        score, _, left, right = min(cuts)
        out.setdefault(lang, []).append((-score, -a, " ".join(words).encode(), left, right))
    rows = []
    for lang, own in out.items():
        for rank, (score, a, phrase, left, right) in enumerate(sorted(own)[:top], 1):
            rows.append((lang, rank, phrase.decode(), -a, left, right, n[lang], -score))
    return sorted(rows)


def corpus(seed, n=300):
    rng = random.Random(seed)
    words = ["red", "Red", "fox", "a", "the", "größe", "x1", "zebra crossing", "\U0001f600", "ab", "b", "of"]
    rows = []
    for i in range(n):
        text = "".join(rng.choice(words) + rng.choice([" "] * 12 + ["  ", "\t", ". ", ",", "\n", " ! "]) for _ in range(rng.randrange(60)))
        rows.append((i, text, rng.choice(["en", "de", None, "und"]), "c", None, "c", 0))
    rows += [(None, None, None, None, None, None, None), (1, "", "en", "c", "c", "c", 1), (2, " \t ", "en", "c", "c", "c", 1), (3, "ab", "en", "c", "c", "c", 1), (4, ",ab", "en", "c", "c", "c", 1)]
    rows += [(5, "same words again and again " * 3, "en", "c", "c", "c", 1)] * 30
    return rows + [(6, "la " * 30_000, "fr", None, None, None, None), (7, "one two three four five. " * 8_000, "fr", None, None, None, None)]


@pytest.mark.parametrize(("longest", "least", "covered", "top", "period"), [(3, 10, 50, 20, 32), (2, 3, 50, None, 3), (4, 4, 80, 2000, 5)])
def test_collocations(spark, longest, least, covered, top, period):
    rows = corpus(longest)
    got = collocations(spark.createDataFrame(rows, SCHEMA).repartition(3), longest, least, covered, top, period)
    assert got.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    assert sorted(map(tuple, got.collect())) == expected(rows, longest, least, covered, top)


def test_counts(spark):
    rows = corpus(9)
    counts, words = phrase_counts(spark.createDataFrame(rows, SCHEMA), 4, 2, 7)
    f, n = counted(rows, 4)
    assert {(r.lang, tuple(r.phrase.split(" "))): r.f for r in counts.collect()} == {k: v for k, v in f.items() if v >= 2}
    assert {r.lang: r.n for r in words.collect()} == {k: v for k, v in n.items() if v}


def test_empty_table_and_other_names(spark):
    assert collocations(spark.createDataFrame([], SCHEMA)).count() == 0
    rows = [(1, "New York is. New York was", "en")] * 10
    got = collocations(spark.createDataFrame(rows, "id long, `a.b` string, `the lang` string"), text="a.b", lang="the lang")
    assert sorted(map(tuple, got.collect())) == expected(rows, 3, 10, 50, 2000)


def test_scores_beyond_64_bits(spark):
    rows = [(1, "up down " * 40_000, "en")] * 4
    got = collocations(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert sorted(map(tuple, got.collect())) == expected(rows, 3, 10, 50, 2000)


def test_parse_covers_each_start_once():
    rng = random.Random(4)
    texts = ["".join(rng.choice(["a", "bb", "ccc"]) + rng.choice([" ", " ", ". "]) for _ in range(rng.randrange(80))) for _ in range(40)]
    data = np.frombuffer("".join(texts).encode(), np.uint8)
    at = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
    rows, held, offsets, tail = parse(data, at, 2, 4, {})
    for i, text in enumerate(texts):
        words = [w for p in pieces(text) for w in p]
        own = [(held[a:b].tobytes().decode().split(), t) for a, b, t in zip(offsets[rows.searchsorted(i) : -1], offsets[rows.searchsorted(i) + 1 :], tail[rows.searchsorted(i) :])][: int((rows == i).sum())]
        assert [w for chunk, t in own for w in chunk[: len(chunk) - t]] == words
        for (chunk, t), (after, _) in zip(own, own[1:]):
            assert t == 2 and chunk[-2:] == after[:2]
