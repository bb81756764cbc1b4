"""Groups of equal texts against plain Python."""

import hashlib
import random
from collections import defaultdict

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from cartolex.llm.exact_dedup import LEAST, MOST, chunk_ends, drop_duplicates, duplicate_groups
from pyspark.sql import functions as F

SCHEMA = "doc_id long, text string, ids string, slice string, keep_id string"


def expected(rows, change=lambda t: t):
    groups = defaultdict(list)
    for d, t, *_ in rows:
        groups[change(t or "")].append(d)
    out = []
    for d, t, *_ in rows:
        own = groups[change(t or "")]
        keep = max((x for x in own if x is not None), default=None)
        out.append((d, keep, len(own), d == keep, hashlib.sha256(change(t or "").encode()).hexdigest()))
    return sorted(out, key=repr)


def odd_rows():
    rng = random.Random(3)
    long = "".join(rng.choice("abcdefg \n") for _ in range(60_000))
    texts = [None, "", "", "a", "a", "A", " a", long, long, long[:-1], long[:30_000] + "!" + long[30_000:], "x" * 50_000, "x" * 50_000, "x" * 50_001, "größe", "größe"]
    rows = [(i, t, "c", None, "c") for i, t in enumerate(texts)]
    rows += [(3, "a", "c", "c", None), (3, "a", "c", "c", None), (None, "a", None, None, None), (None, "only here", "c", "c", "c"), (None, None, "c", "c", "c")]
    return rows + [(100 + i, "copies everywhere", "c", "c", "c") for i in range(400)]


def test_groups(spark):
    rows = odd_rows()
    got = duplicate_groups(spark.createDataFrame(rows, SCHEMA).repartition(5))
    assert got.columns == ["doc_id", "keep_id", "group_size", "kept", "text_sha256"]
    assert sorted(map(tuple, got.collect()), key=repr) == expected(rows)


def test_short_digests_are_found_out(spark):
    """With digests of one byte, different chunks share one: the groups are right all the same."""
    rng = random.Random(5)
    rows = [(i, "".join(rng.choice("ab ") for _ in range(5))) for i in range(600)]
    got = duplicate_groups(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), id_bytes=1)
    assert sorted(map(tuple, got.collect()), key=repr) == expected(rows)


def test_normalised(spark):
    rows = odd_rows()
    got = duplicate_groups(spark.createDataFrame(rows, SCHEMA), lambda c: F.translate(c, " A", "a"))
    assert sorted(map(tuple, got.collect()), key=repr) == expected(rows, lambda t: t.translate({32: "a", 65: None}))


def test_empty_table_and_other_names(spark):
    assert duplicate_groups(spark.createDataFrame([], SCHEMA)).count() == 0
    rows = [(1, "x"), (2, "x"), (3, "y")]
    got = duplicate_groups(spark.createDataFrame(rows, "`a.b` long, `the text` string"), doc_id="a.b", text="the text")
    assert sorted(map(tuple, got.collect()), key=repr) == expected(rows)


def test_drop(spark):
    rows = odd_rows()
    left = drop_duplicates(spark.createDataFrame(rows, SCHEMA))
    assert left.columns == ["doc_id", "text", "ids", "slice", "keep_id"]
    kept = {(d, h) for d, _, _, k, h in expected(rows) if k}
    want = [r for r in rows if (r[0], hashlib.sha256((r[1] or "").encode()).hexdigest()) in kept]
    assert sorted(map(tuple, left.collect()), key=repr) == sorted(want, key=repr)


@settings(max_examples=40, deadline=None)
@given(st.lists(st.integers(0, 60_000), max_size=4), st.integers(0, 5))
def test_chunks_depend_on_the_text_alone(sizes, seed):
    rng = np.random.default_rng(seed)
    texts = [rng.integers(97, 105, n).astype(np.uint8) for n in sizes]
    at = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
    together = chunk_ends(np.concatenate([np.zeros(0, np.uint8), *texts]), at)
    for start, text, ends in zip(at, texts, together):
        assert [e - start for e in ends] == chunk_ends(text, np.array([0, len(text)]))[0]
        bounds = [start, *ends]
        assert (ends[-1] if ends else start) == start + len(text)
        widths = np.diff(bounds)
        assert (widths <= MOST).all() and (widths[:-1] >= LEAST).all()


def test_insertion_moves_few_chunks():
    rng = np.random.default_rng(1)
    text = rng.integers(97, 123, 200_000).astype(np.uint8)
    other = np.concatenate([text[:5_000], text[:1], text[5_000:]])

    def chunks(t):
        ends = chunk_ends(t, np.array([0, len(t)]))[0]
        return {t[a:b].tobytes() for a, b in zip([0, *ends], ends)}

    one, two = chunks(text), chunks(other)
    assert len(one) > 50 and len(one & two) >= len(one) - 3
