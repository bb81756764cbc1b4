"""Counts against the libraries; what is in the cache is not encoded again."""

import public_tokenizers as public
import pytest
import sentencepiece
from tokenizers import Tokenizer

from cartolex.llm.token_counts import count_tokens

SCHEMA = "doc_id long, text string, content string, n_tokens string"
ROWS = [
    (1, "Hello world", "x", "y"), (2, "Hello world", "x", None), (3, None, None, None), (4, "", "x", "y"), (5, "  a  b\n\nc ", "x", "y"),
    (6, "<s> special </s> <|endoftext|>", "x", "y"), (7, "x" * 20_000, "x", "y"), (7, "twice", "x", "y"), (7, "twice", "x", "y"), (None, "no id", "x", "y"), (None, "Hello world", "x", "y"),
    (8, "größe ñandú 漢字 \U0001f600", "x", "y"),
]


def counters():
    model = sentencepiece.SentencePieceProcessor(model_file=public.path("piece_bpe_32k.model"))
    own = Tokenizer.from_file(public.path("word_bpe_49k.json"))
    return {
        "piece_bpe_32k.model": lambda t: len(model.encode(t)),
        "word_bpe_49k.json": lambda t: len(own.encode(t, add_special_tokens=False).ids),
    }


@pytest.mark.parametrize("name", ["piece_bpe_32k.model", "word_bpe_49k.json"])
def test_counts(spark, name):
    count = counters()[name]
    got = sorted(map(tuple, count_tokens(spark.createDataFrame(ROWS, SCHEMA).repartition(3), public.path(name)).collect()), key=repr)
    assert got == sorted(((d, len((t or "").encode()), count(t or "")) for d, t, *_ in ROWS), key=repr)


def test_cache_is_used_and_extended(spark, tmp_path):
    cache = str(tmp_path / "counts")
    path = public.path("piece_bpe_32k.model")
    count_tokens(spark.createDataFrame(ROWS[:2], SCHEMA), path, cache)
    stored = spark.read.parquet(cache)
    assert stored.count() == 1  # two rows, one content
    # A stored count is taken as it is: the text is not encoded again.
    other = stored.selectExpr("content", "tokenizer", "n_tokens + 1000 AS n_tokens").collect()
    spark.createDataFrame(other, stored.schema).write.mode("append").parquet(cache)
    got = {r.doc_id: r.n_tokens for r in count_tokens(spark.createDataFrame(ROWS[:5], SCHEMA), path, cache).collect()}
    assert got[1] == got[2] > 1000 > got[5] and got[3] == got[4] == 0
    assert spark.read.parquet(cache).select("content").distinct().count() == 3
    # Another tokenizer does not see these counts.
    assert all(r.n_tokens < 1000 for r in count_tokens(spark.createDataFrame(ROWS[:2], SCHEMA), public.path("word_bpe_49k.json"), cache).collect())


def test_empty_table(spark):
    assert count_tokens(spark.createDataFrame([], SCHEMA), public.path("piece_bpe_32k.model")).count() == 0


def test_names_with_dots_and_clashes(spark):
    names = "`doc.id` long, `the.text` string, doc_id string, text string, row string, content string, n_bytes string, n_tokens string"
    rows = [(d, t, "q", "other words", "r", "c", "b", "n") for d, t, *_ in ROWS]
    df = spark.createDataFrame(rows, names)
    path, count = public.path("piece_bpe_32k.model"), counters()["piece_bpe_32k.model"]
    got = count_tokens(df, path, doc_id="doc.id", text="the.text")
    assert got.columns == ["doc_id", "n_bytes", "n_tokens"]
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(((d, len((t or "").encode()), count(t or "")) for d, t, *_ in ROWS), key=repr)
