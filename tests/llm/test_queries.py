"""The registered queries on whole test tables, against SQL or brute force."""

import base64
import hashlib
import os

import public_tokenizers as public
import pytest
import sentencepiece
import tiktoken

import __spark_entry__ as entry
from cartolex.llm import queries as q
from cartolex.llm.bpe import read_file, read_ranks
from cartolex.llm.common import table
from tests import harness
from tests.llm import test_decontaminate, test_near_dedup, test_personal_data, test_suffix_dedup, test_url_filter, test_warc

FOLDER = os.environ.get("LLM_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def documents(spark):
    return [(r.doc_id, r.text) for r in table(spark, FOLDER, "documents").select("doc_id", "text").collect()]


def rows(spark, name):
    df = q.QUERIES[name](spark, FOLDER)
    return df.columns, sorted(map(tuple, df.collect()), key=repr)


def sha(text):
    return hashlib.sha256(text if isinstance(text, bytes) else text.encode()).hexdigest()


def test_all_are_registered():
    assert {n.split("_")[0] for n in q.QUERIES} == {f"op{k}" for k in range(1, 14)}
    assert set(q.QUERIES) | {"pipeline"} <= set(entry.queries())
    assert set(q.ORACLES) <= set(entry.oracle_sql())


@pytest.mark.parametrize("name", sorted(q.ORACLES))
def test_sql(spark, name):
    assert harness.difference(q.QUERIES[name](spark, FOLDER), harness.connect(FOLDER), q.ORACLES[name]) is None


def test_op1(spark):
    pages = [(r.page_id, r.url, r.html) for r in table(spark, FOLDER, "pages").collect()]
    columns, got = rows(spark, "op1_warc")
    assert columns[:5] == ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    assert got == sorted(((k, n, d, t, to) for k, t, n, d, to in test_warc.expected(pages, 0)), key=repr)


def test_op2(spark, documents):
    columns, got = rows(spark, "op2_suffix_dedup")
    assert columns == ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
    assert got == test_suffix_dedup.brute([(d, t, None) for d, t in documents])


def test_op3(spark, documents):
    columns, got = rows(spark, "op3_near_dedup")
    assert columns == ["doc_id", "n_shingles", "component_id", "kept"]
    assert got == test_near_dedup.brute(documents, 4)


def test_op4(spark, documents):
    columns, got = rows(spark, "op4_personal_data")
    assert columns == ["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans"]
    text = dict(documents)
    for d, *counts, digest, spans in got:
        own = test_personal_data.base(text[d])
        listed = [f"{k}:{a}:{b}" for a, _, b, k in own]
        assert counts == [sum(k == kind for *_, k in own) for kind in ("email", "ip", "card", "phone")]
        assert digest == sha(",".join(listed)) and set(listed) <= set(spans.split(",")) | {""}


def test_op5(spark, documents):
    columns, got = rows(spark, "op5_quality")
    assert columns == ["doc_id", "expected_grade", "chance", "kept"] and len(got) == len(documents)
    assert all(0 <= g <= 2 and k == (c >= q.LEAST_CHANCE) for _, g, c, k in got)


def test_op6(spark, documents):
    ranks = read_ranks(read_file(public.path("byte_bpe_50k.tiktoken")))
    library = tiktoken.Encoding("own", pat_str=public.PATTERN, mergeable_ranks=ranks, special_tokens={})
    want = []
    for d, t in documents:
        ids = library.encode_ordinary(t or "")
        want.append((d, len(ids), sha(" ".join(map(str, ids))), sha(t or "")))
    columns, got = rows(spark, "op6_byte_bpe")
    assert columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"] and got == sorted(want, key=repr)


def test_op7(spark, documents):
    model = sentencepiece.SentencePieceProcessor(model_file=public.path("piece_bpe_32k.model"))
    counts = [(d, len((t or "").encode()), len(model.encode(t or ""))) for d, t in documents]
    columns, got = rows(spark, "op7_token_counts")
    assert columns == ["doc_id", "n_bytes", "n_tokens", "over_limit"]
    assert got == sorted(((d, b, n, n > 4096) for d, b, n in counts), key=repr)


def test_op8(spark):
    columns, got = rows(spark, "op8_url_filter")
    assert columns[:5] == ["page_id", "host", "path", "rule", "verdict"]
    urls = {r.page_id: r.url for r in table(spark, FOLDER, "pages").collect()}
    assert len(got) == len(urls)
    for page, host, path, rule, verdict, *_ in got:
        assert (host, path) == test_url_filter.plain(urls[page])
        own, says = test_url_filter.rule(host, path)
        assert rule == own and verdict in ("allow", "block") and (says is None or verdict == says)


def test_op10(spark, documents):
    items = [(r.item_id, r.text) for r in table(spark, FOLDER, "benchmark").collect()]
    want = []
    for d, n, hit, met in test_decontaminate.brute(documents, items, 10):
        want.append((d, n, hit, len(met), sha(",".join(sorted(map(str, met)))), hit > 0))
    columns, got = rows(spark, "op10_decontaminate")
    assert columns == ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"] and got == sorted(want, key=repr)


def test_digest_of_nothing():
    assert base64.b32encode(hashlib.sha1(b"").digest()).decode() == "3I42H3S6NNFQ2MSVX7XZKYAYSCX5QBYJ"
