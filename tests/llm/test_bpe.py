"""Ids against the public library, and the exact way back."""

import base64
import random

import numpy as np
import public_tokenizers as public
import pytest
import tiktoken

from cartolex.llm.bpe import WORDS, Codec, decode, encode, read_file

PATH = public.path("byte_bpe_50k.tiktoken")


@pytest.fixture(scope="module")
def library():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, read_file(PATH).splitlines())}
    return tiktoken.Encoding("own", pat_str=public.PATTERN, mergeable_ranks=ranks, special_tokens={})


def texts():
    rnd = random.Random(1)
    out = [None, "", " ", "\n", "a" * 3000, "ab" * 200, " " * 500, "\n" * 77 + "x", "don't we'll I'd ''s 's", "<|endoftext|> x", "1" * 99, "x\x1cy\x1f z", "\0a\0"]
    for _ in range(300):
        size = rnd.randrange(0, 60)
        out.append("".join(chr(rnd.choice([rnd.randrange(1, 0xD800), rnd.randrange(0xE000, 0x110000), rnd.randrange(32, 127), 10, 32, 32, 39])) for _ in range(size)))
    syllables = "the an ion é ß ing o ñ ü '' . ,\n 's".split(" ")
    out += ["".join(rnd.choice(syllables) + rnd.choice(["", " "]) for _ in range(rnd.randrange(400))) for _ in range(100)]
    return out


@pytest.mark.parametrize("words", [None, WORDS])
def test_against_library(spark, library, words):
    rows = [(i, t, "kept") for i, t in enumerate(texts())] + [(0, "again", None), (None, "no id", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids string").repartition(3)
    got = decode(encode(df, PATH, public.PATTERN, words), PATH).collect()
    assert len(got) == len(rows)
    for r in got:
        assert r.ids == library.encode_ordinary(r.text or "")
        assert bytes(r.decoded) == (r.text or "").encode()


def test_long_text_in_parts(library, monkeypatch):
    from cartolex.llm import bpe

    monkeypatch.setattr(bpe, "SPLIT", 80)
    codec = Codec(read_file(PATH), public.PATTERN, WORDS)
    some = [t or "" for t in texts()]
    for own, text in zip(codec.encode(some), some, strict=True):
        assert [int.from_bytes(own[i : i + 4], "little") for i in range(0, len(own), 4)] == library.encode_ordinary(text)


def test_forgetting(library, monkeypatch):
    from cartolex.llm import bpe

    monkeypatch.setattr(bpe, "REMEMBERED", 5)
    codec = Codec(read_file(PATH), public.PATTERN, WORDS)
    for text in texts()[:60]:
        own = codec.encode([text or "", "other words here"])[0]
        assert len(own) == 4 * len(library.encode_ordinary(text or ""))


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert encode(df, PATH, public.PATTERN).columns == ["doc_id", "text", "ids"]
    assert encode(df, PATH, public.PATTERN).count() == 0


def test_clashing_names_and_repeated_rows(spark, library):
    rows = [(1, "Hello world", "old", "old", 5), (1, "Hello world", "old", "old", 5), (None, None, None, None, None), (2, "", "x", "y", 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids string, decoded string, `n.tokens` int")
    got = decode(encode(df, PATH, public.PATTERN, WORDS), PATH)
    assert got.columns == ["doc_id", "text", "n.tokens", "ids", "decoded"]
    want = [(d, t, n, library.encode_ordinary(t or ""), (t or "").encode()) for d, t, _, _, n in rows]
    assert sorted(((r[0], r[1], r[2], list(r[3]), bytes(r[4])) for r in got.collect()), key=repr) == sorted(want, key=repr)


def test_leaves_are_as_narrow_as_the_ranks_allow():
    rows = [(bytes([i]), i) for i in range(256)] + [(b"ab", 256), (b"bc", 257), (b"abc", 258), (b"cab", 259)]
    far = 1 << 27
    texts = ["abcab cabbc", "", "a" * 20 + "bcab" * 30, "éabc"]

    def coded(by):
        content = b"\n".join(base64.b64encode(t) + b" %d" % (r + by) for t, r in rows)
        own = Codec(content, r" ?[^ ]+| ")
        return own.kind, [np.frombuffer(x, "<i4").tolist() for x in own.encode(texts)]

    narrow, near_ids = coded(0)
    wide, far_ids = coded(far)
    assert (narrow, wide) == (np.int32, np.int64)
    assert [[i - far for i in ids] for ids in far_ids] == near_ids
