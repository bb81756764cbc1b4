"""Text and links of broken pages, as browsers read them."""

import tracemalloc

import pyarrow as pa
import pytest

from cartolex.functions.markup import attribute, page_parts, parsed, parts_of

TEXTS = {
    "<p>one<p>two": "one\ntwo",
    "<ul><li>a<li>b</ul>c": "a\nb\nc",
    "<li>a<ul><li>b</ul><li>c": "ab\nc",
    "<table><tr><td>a<td>b<tr><td>c</table>d": "ab\nc\nd",
    '<p title="a>b">t</p>1 < 2 <3 &lt;x&gt; <b>y': "t\n1 < 2 <3 <x> y",
    "<p title='</p>'>x": "x",
    "<h1>t<p>x</h1>y": "tx\ny",
    "<p>x</div>y</p>z": "xy\nz",
    "a</p>b": "a\nb",
    "a</br>b<br/>c": "a\nb\nc",
    "<head><title>T</title></head><body>hi<script>var a=\"</p>\";</script><br>x": "hi\nx",
    "<title>only</title>body": "body",
    "text <!-- c --> more <!-- open": "text more",
    "<svg><path/><text>no</text></svg>yes": "yes",
    "<noscript><p>no</p></noscript>ok<template>no</template>": "ok",
    "<script>if (a < b) '</div>'</SCRIPT >seen": "seen",
    "<script>never ends": "",
    "<textarea><p>x</textarea>y": "<p>xy",
    "&eacute;&nbsp;&#x41;&amp;lt;&copy": "é A&lt;©",
    "a<b": "a",
    "a</>b<!x>c<?y>d</ z>e": "abcde",
    "<div>one<section>two</div>three": "onetwo\nthree",
    "\ufeff x \n\n\t y \u3000": "x\ny",
    "": "",
}


@pytest.mark.parametrize("page", TEXTS)
def test_text(page):
    assert page_parts(page)[0] == TEXTS[page]


def test_links():
    links = lambda page: page_parts(page)[1]
    assert links('<a href=/1>one<a href="/2">two</a> x') == [("/1", "one"), ("/2", "two")]
    assert links("<a title=it's href='/q?a=1&amp;b'>k</a><a name=x>no</a>") == [("/q?a=1&b", "k")]
    assert links('<a href="/x"><b>B</b> C</a>') == [("/x", "B C")]
    assert links("<A HREF = /u >up") == [("/u", "up")]
    # A link that its block ends goes on in the next one.
    assert links("<div><a href=x>one</div><div>two</div>") == [("x", "one"), ("x", "two")]
    assert links("<ul><li><a href=1>one<li><a href=2>two</a></ul>three") == [("1", "one"), ("2", "two")]


def test_attributes():
    assert attribute(' a=1 href="x>y" href=z', "href") == "x>y"
    assert attribute(" data-href=1", "href") is None
    assert attribute(" href", "href") == ""


def test_long_pages_take_linear_time():
    for page in ("<p" * 200_000, "<" * 300_000, "<a href=\"" * 50_000, "<!--" * 100_000, "<p>" * 50_000, "<b><i>" * 3_000 + "x" * 1000):
        page_parts(page)


def test_rows(spark):
    got = spark.createDataFrame([(1, "<p>a<p>b"), (2, None), (3, "")], "id int, html string").select("id", parsed("html").alias("p")).select("id", "p.text", "p.links")
    assert sorted(map(tuple, got.collect())) == [(1, "a\nb", []), (2, None, None), (3, "", [])]


def test_a_batch_is_never_whole_as_python_objects():
    page = "".join(f"<li><a href='/p/{i}'>link number {i}" for i in range(100))
    pages = pa.array([None, *[f"{page} {i}" for i in range(1500)]], pa.string())
    tracemalloc.start()
    found = parts_of(pages)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < pages.nbytes and len(found) == 1501 and found[0].as_py() is None
    text, links = page_parts(f"{page} 1499")
    assert found[1500].as_py() == {"text": text, "links": [{"href": h, "text": t} for h, t in links]}
    assert len(parts_of(pages.slice(0, 0))) == 0
