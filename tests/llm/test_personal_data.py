"""Base spans against Python's regular expressions, the learned parts, and masking."""

import random
import re

import pytest

from cartolex.llm import personal_data as p

PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
SCHEMA = "doc_id long, text string, kind string, spans string, row int"


def luhn(d):
    return sum(x if i % 2 == 0 else 2 * x - 9 * (x > 4) for i, x in enumerate(map(int, reversed(d)))) % 10 == 0


def base(text):
    out = []
    for place, (kind, pattern) in enumerate(PLAIN.items()):
        for m in re.finditer(pattern, text or ""):
            d = re.sub("[^0-9]", "", m[0])
            if kind == "ip" and any(int(x) > 255 for x in m[0].split(".")):
                continue
            if kind == "card" and not (14 <= len(d) <= 19 and luhn(d)) or kind == "phone" and not 10 <= len(d) <= 15:
                continue
            out.append((m.start(), place, m.end(), kind))
    return sorted(out)


def texts():
    rnd = random.Random(4)
    bits = [
        "a.b@c.de", "x@y", "@", "a@b.c_d@e.f", "1.2.3.4", "1.2.3.4.5.6.7.8", "300.1.1.1", "0255.1.01.1", "4111 1111 1111 1111", "4111-1111-1111-1111", "4111111111111111", "5500 0000 0000 0004", "1234567890123456",
        "+1 (988) 555-2485", "+49 30 1234567", "+1", "+1-", "+12345678901234567", " ", " ", ", ", "-", ".", "\n", "é", "\U0001f600", "word", "9", "42", "(", ")", "+", "--", "call 415-555-2671 now", "bob (at) mail [dot] org",
    ]
    return ["".join(rnd.choice(bits) for _ in range(rnd.randint(0, 25))) for _ in range(400)]


@pytest.mark.parametrize("seed", [0])
def test_base_spans(spark, seed):
    rows = [(i, t, "x", "y", 1) for i, t in enumerate(texts())] + [(None, "a@b.cd", "x", "y", 1), (3, None, None, None, None), (3, "", "x", "y", 1), (3, "é a@b.cd", "x", "y", 1)]
    got = p.find_personal_data(spark.createDataFrame(rows, SCHEMA).repartition(3), keep=("text",)).collect()
    assert len(got) == len(rows)
    for r in got:
        assert [(s.start, s.place - 1, s.end, s.kind) for s in r.spans if s.base] == base(r.keep_0), r.keep_0
        for s in r.spans:
            assert s.base or not any(s.start < b.end and b.start < s.end for b in r.spans if b.base)


def test_long_runs_end_soon(spark):
    rows = [(i, c * 200_000, "x", "y", 1) for i, c in enumerate(["1", "a", "1 ", "1.", "a@", "+1", "a.", "1-1.1 ", "+1("])]
    got = p.find_personal_data(spark.createDataFrame(rows, SCHEMA).repartition(4)).collect()
    assert {r.doc_id: len(r.spans) for r in got}[0] == 0


def test_reliabilities_are_learned():
    # Three labelers that are mostly right, one that is mostly wrong, one that never votes.
    rnd = random.Random(2)
    counts: dict = {}
    for _ in range(4000):
        truth = rnd.random() < 0.4
        vote = lambda right: (1 if truth == (rnd.random() < right) else -1)  # noqa: E731, B023
        key = ("email", truth, 1, vote(0.95), vote(0.9), 0, vote(0.85), vote(0.3))
        counts[key] = counts.get(key, 0) + 1
    model = p.Model([(*k, n) for k, n in counts.items()])
    assert model.rates["strict", True, 1] > 0.85 and model.rates["shape", True, 1] < 0.45
    assert abs(model.prior["email"] - 0.4) < 0.08
    right = sum(n for k, n in counts.items() if (model.chance(model.features("email", k[1], 1, k[3:])) > 0.5) == k[1])
    assert right > 3700


def test_wide_forms(spark):
    rows = [(i, f"some words and mail me at user{i}@mail.example.com or +1 (988) 555-24{i:02d} today", "x", "y", 1) for i in range(40)]
    rows += [(100, "please call 415-555-2671 now", "x", "y", 1), (101, "contact bob.w (at) mail (dot) org please", "x", "y", 1), (102, "version 2.0 of 1234 things", "x", "y", 1)]
    got = {r.doc_id: [(s.kind, s.start, s.end) for s in r.spans] for r in p.find_personal_data(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got[100] == [("phone", 12, 24)] and got[101] == [("email", 8, 33)] and got[102] == []


def test_mask(spark):
    rows = [(1, "é a@b.cd, +1 (988) 555-2485.", 28), (2, "clean", 5), (3, None, None), (4, "4041894974608795", 16)]
    out = p.mask_personal_data(spark.createDataFrame(rows, "doc_id long, text string, n_chars long"))
    assert out.columns == ["doc_id", "text", "n_chars"]
    assert {tuple(r) for r in out.collect()} == {(1, "é <EMAIL>, <PHONE>.", 19), (2, "clean", 5), (3, None, None), (4, "<CARD>", 6)} - ({(4, "<CARD>", 6)} if not luhn("4041894974608795") else set()) | (set() if luhn("4041894974608795") else {(4, "4041894974608795", 16)})


def test_empty_table(spark):
    assert p.find_personal_data(spark.createDataFrame([], SCHEMA)).collect() == []
