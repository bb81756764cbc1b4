"""The pipeline on the smallest tables: each stage against what plain Python finds in its input."""

import re

import public_tokenizers as public
import tiktoken

import corpus_pipeline as c
from cartolex.llm.bpe import read_file, read_ranks
from cartolex.llm.common import stored, table
from tests.llm.test_decontaminate import words as plain_words
from tests.llm.test_near_dedup import brute as near_brute
from tests.llm.test_personal_data import base

FOLDER = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = table(spark, FOLDER, "documents")
    columns, held = docs.columns, {}
    before = docs
    for name, stage in c.STAGES:
        after = stored(stage(spark, before, FOLDER), f"test-{name}")
        if name != "tokens":
            assert after.columns == columns
        held[name] = ([r.asDict() for r in before.collect()], [r.asDict() for r in after.collect()])
        before = after

    given = {r.doc_id: (r.quality, r.toxic) for r in table(spark, FOLDER, "labels").collect()}
    kept = {r["doc_id"] for r in held["quality"][1]}
    clean = [d for d, (q, t) in given.items() if q == 1 and t == 0]
    # These are 86 labels; test_quality_with_more_labels has a fairer number.
    assert sum(d in kept for d in clean) >= 0.75 * len(clean)
    bad = [d for d, (q, t) in given.items() if q != 1]
    assert sum(d in kept for d in bad) <= 0.1 * len(bad)

    was, now = held["near_dedup"]
    want = {d for d, _, _, keep in near_brute([(r["doc_id"], r["text"]) for r in was], 5) if keep}
    assert {r["doc_id"] for r in now} == want

    was, now = held["decontaminate"]
    items = [plain_words(r.text) for r in table(spark, FOLDER, "benchmark").collect()]
    windows = {tuple(w[k : k + min(10, len(w))]) for w in items if w for k in range(len(w) - min(10, len(w)) + 1)}
    new = {r["doc_id"]: r["text"] for r in now}
    for r in was:
        own = plain_words(r["text"])
        leaks = any(tuple(own[i : i + n]) in windows for n in {len(w) for w in windows} for i in range(len(own) - n + 1))
        if not leaks:
            assert new[r["doc_id"]] == r["text"]
        else:
            assert len(plain_words(new.get(r["doc_id"], ""))) < len(own)

    was, now = held["personal_data"]
    new = {r["doc_id"]: r["text"] for r in now}
    assert len(new) == len(was)
    for r in was:
        if base(r["text"]):
            assert re.search("<(EMAIL|IP|CARD|PHONE)>", new[r["doc_id"]]) and not base(new[r["doc_id"]])

    was, now = held["tokens"]
    library = tiktoken.Encoding("own", pat_str=public.PATTERN, mergeable_ranks=read_ranks(read_file(c.RANKS)), special_tokens={})
    text = {r["doc_id"]: r["text"] for r in was}
    assert len(now) == len(was)
    for r in now:
        assert r["round_trip"] and r["ids"] == library.encode_ordinary(text[r["doc_id"]]) and r["n_tokens"] == len(r["ids"])


def test_quality_with_more_labels(spark):
    folder = "/root/testdata/sf0.1"
    kept = {r.doc_id for r in c.quality(spark, table(spark, folder, "documents"), folder).select("doc_id").collect()}
    given = {r.doc_id: (r.quality, r.toxic) for r in table(spark, folder, "labels").collect()}
    clean, toxic, poor = ([d for d, x in given.items() if x == y] for y in ((1, 0), (1, 1), (0, 0)))
    assert sum(d in kept for d in clean) >= 0.97 * len(clean)
    assert sum(d in kept for d in toxic) <= 0.15 * len(toxic)
    assert sum(d in kept for d in poor) <= 0.05 * len(poor)


def test_run_is_the_stages(spark):
    assert c.run(spark, FOLDER).columns == ["doc_id", "lang", "source", "n_tokens", "round_trip", "ids"]
    assert [name for name, _ in c.STAGES] == ["quality", "near_dedup", "decontaminate", "personal_data", "tokens"]


def test_empty_documents(spark):
    docs = table(spark, FOLDER, "documents").limit(0)
    for _, stage in c.STAGES:
        docs = stored(stage(spark, docs, FOLDER), "test-empty")
    assert docs.count() == 0


def test_odd_documents(spark):
    rows = [(None, None, None, None, None), (1, None, "en", "s", 0), (2, "", "en", "s", 0), (3, "a", "en", "s", 1), (3, "a", "en", "s", 1), (4, "x " * 30_000, "en", "s", 60_000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for _, stage in c.STAGES[1:]:
        docs = stored(stage(spark, docs, FOLDER), "test-odd")
    assert docs.count() == 6
