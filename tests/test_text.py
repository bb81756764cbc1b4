import random

import pytest
from pyspark.sql import functions as F

from cartolex.functions import attributes as at
from cartolex.functions import html, text
from cartolex.functions.html import anchors, fragment_text, resolve_links, visible_text
from cartolex.functions.text import clean_url, host_of, normalize_text, normalize_variety, singularize
from cartolex.operators.entities import note_families
from cartolex.operators.keep import computed
from cartolex.operators.lexicon import gazetteer_matches, gazetteer_scan, lexicon_map, lookup_name
from cartolex.sources.dims import as_lexicon, country_lexicon, note_lexicon, read_lexicon
from cartolex.vocab import rules


def one(spark, fn, *values):
    """The expression's value for one row."""
    row = spark.createDataFrame([values], ", ".join(f"v{i} string" for i in range(len(values))))
    return row.select(fn(*[F.col(f"v{i}") for i in range(len(values))]).alias("x")).first().x


@pytest.mark.parametrize(
    "raw, key",
    [
        ("Café  d’Été — 12oz", "cafe dete 12oz"),
        ("  São\tPaulo & Ñandú ", "sao paulo nandu"),
        ("ﬁne Ｆｕｌｌ №5 Straße", "fine full no5 stra e"),
        ("élan", "elan"),
        ("", ""),
    ],
)
def test_normalize(spark, raw, key):
    assert one(spark, normalize_text, raw) == key


def test_varieties_and_plurals(spark):
    assert [one(spark, normalize_variety, v) for v in ("SL-28", "Geisha", "Ruiru 11", "SL28")] == ["sl28", "gesha", "ruiru11", "sl28"]
    words = {"berries": "berry", "pies": "pie", "peaches": "peach", "tomatoes": "tomato", "figs": "fig", "gas": "gas", "grass": "grass"}
    assert {w: one(spark, singularize, w) for w in words} == words


@pytest.mark.parametrize(
    "raw, clean",
    [
        ("example.com/", "https://example.com"),
        ("HTTPS://Foo.COM:8080/a/b/?q=1#x", "https://foo.com/a/b"),
        ("host:8080", "https://host"),
        ("mailto:a@b.c", None),
        ("javascript:alert(1)", None),
        ("https://www.instagram.com/foo", None),
        ("https://x.com/a", None),
        ("https://netflix.com/a", "https://netflix.com/a"),
        ("", None),
        (None, None),
    ],
)
def test_clean_url(spark, raw, clean):
    assert one(spark, clean_url, raw) == clean


def test_roast_and_process(spark):
    roast = {"Medium-Light": "medium-light", "Full City": "medium-dark", "Nordic": "light", "Vienna": "dark", "whole": None}
    assert {t: one(spark, at.parse_roast, t) for t in roast} == roast
    found = {"Our light roast is nice": "light", "Roast level: Medium-Dark": "medium-dark", "espresso roast": None, "dark chocolate": None}
    assert {t: one(spark, at.find_roast, t) for t in found} == found
    process = {
        "Process: Pulped natural\nmore": "honey",
        "Process: magic\nnatural process": None,
        "natural sweetness": None,
        "an anaerobic lot": "anaerobic",
        "honey processed": "honey",
    }
    assert {t: one(spark, at.find_process, t) for t in process} == process


def test_multi_tags(spark):
    assert one(spark, at.find_varieties, "Pink Bourbon, bourbon and SL 28") == ["pink bourbon", "sl28"]
    assert one(spark, at.find_varieties, "aged in bourbon barrel") == []
    assert one(spark, at.find_notes, "Tasting Notes: Blueberry, milk chocolate & jasmine.") == ["Blueberry", "milk chocolate", "jasmine"]
    assert one(spark, at.find_notes, "nothing here") == []
    sizes = {"12 oz": 340, "2 lb bag": 907, "1.5kg": 1500, "no": None, "0 g": None}
    assert {t: one(spark, at.parse_size_grams, t) for t in sizes} == sizes
    assert one(spark, at.is_decaf_text, "Swiss Water") and not one(spark, at.is_decaf_text, "regular")


@pytest.mark.parametrize(
    "title, kind, target",
    [
        ("Ethiopia Guji", "", True),
        ("House Blend", "Coffee", True),
        ("Coffee Mug", "Coffee", False),
        ("Espresso Blend", "Tea", False),
        ("Logo", "", False),
        ("Kenya AA", "Gift Card", False),
    ],
)
def test_products(spark, title, kind, target):
    tags = F.array().cast("array<string>")
    assert one(spark, lambda t, k: at.is_target_product(t, k, tags), title, kind) is target


def test_html(spark):
    page = "<html><head><title>T</title></head><body><script>x</script><p>a&nbsp; b</p><div>c<br>d</div><!-- e --></body></html>"
    assert one(spark, visible_text, page) == "a b\nc\nd"
    assert one(spark, fragment_text, " plain & simple ") == "plain & simple"
    assert one(spark, fragment_text, "<p>x &amp; y</p><p>z</p>") == "x & y\nz"
    links = '<a class=x href="/menu">Our <b>Menu</b></a><a href=\'sub/../b?q=ü#f\'>B</a><a href="//www.s.com/c d">C</a><a href="mailto:x">D</a><a href="">E</a>'
    found = one(spark, lambda h, b: resolve_links(b, anchors(h)), links, "https://S.com/x/y?z=1#t")
    assert [(r.text, r.url) for r in found] == [
        ("Our Menu", "https://s.com/menu"),
        ("B", "https://s.com/x/b?q=%C3%BC"),
        ("C", "https://www.s.com/c%20d"),
        ("D", None),
        ("E", "https://s.com/x/y?z=1"),
    ]
    assert one(spark, host_of, "https://WWW.Foo.com:8080/x") == "foo.com"


def singular_model(w):
    if w.endswith("ies") and len(w) > 4:
        return w[:-3] + "y"
    if any(w.endswith(e) for e in ("ches", "shes", "xes", "sses")):
        return w[:-2]
    if w.endswith("oes") and len(w) > 4:
        return w[:-2]
    return w[:-1] if w.endswith("s") and not w.endswith("ss") and len(w) > 3 else w


def lexicon_model(text, lexicon):
    words, used, out = text.split(), set(), []
    for n in (4, 3, 2, 1):
        for i in range(len(words) - n + 1):
            span = set(range(i, i + n))
            run = words[i : i + n]
            value = lexicon.get(" ".join(run)) or lexicon.get(" ".join(map(singular_model, run)))
            if value and not span & used:
                used |= span
                if value not in out:
                    out.append(value)
    return out


def test_lexicon_same_as_model(spark):
    rnd = random.Random(5)
    words = ["rose", "roses", "black", "tea", "teas", "green", "apple", "pie", "x"]
    phrases = {"rose": "A", "black tea": "B", "tea": "C", "green apple pie": "D", "apple": "E", "black": "F", "tea green apple": "G", "x x": "H"}
    texts = [(i, " ".join(rnd.choices(words, k=rnd.randint(0, 30)))) for i in range(200)]
    lexicon = as_lexicon(spark.createDataFrame(list(phrases.items()), "phrase string, value string"))
    got = {r.id: r["values"] for r in lexicon_map(spark.createDataFrame(texts, "id int, t string"), "id", F.col("t"), lexicon).collect()}
    for i, text in texts:
        assert got.get(i, []) == lexicon_model(text, phrases), text


def test_notes(spark, tmp_path):
    items = spark.createDataFrame([(1, ["Jammy Blackberry", "zzz", "dark chocolates"]), (2, ["roses"]), (3, [])], "id int, notes array<string>")
    families, unmapped = note_families(items, "id", F.col("notes"), note_lexicon(spark))
    assert {r.id: r.families for r in families.collect()} == {
        1: ["fruity/other-fruit", "fruity/berry", "nutty-cocoa/cocoa"],
        2: ["floral/floral"],
    }
    assert [(r.id, r.note) for r in unmapped.collect()] == [(1, "zzz")]
    (tmp_path / "more.csv").write_text("phrase,value\nZzz,other\n")
    more = note_lexicon(spark, read_lexicon(spark, str(tmp_path / "more.csv")))
    assert [r.value for r in more.filter("phrase = 'zzz'").collect()] == ["other"]


def test_gazetteer(spark):
    places = country_lexicon(spark)
    texts = spark.createDataFrame([(1, "Papua New Guinea and Sidamo in co"), (2, "nowhere")], "id int, t string")
    assert [r["values"] for r in gazetteer_scan(texts, "id", F.col("t"), places).collect()] == [["PG", "GN", "ET"]]
    assert [r["values"] for r in gazetteer_scan(texts, "id", F.col("t"), places, consume=True).collect()] == [["PG", "ET"]]
    named = spark.createDataFrame([("Côte d'Ivoire",), ("Sumatra",), ("Mars",)], "n string")
    assert [r.code for r in lookup_name(named, F.col("n"), places, "code").orderBy("n").collect()] == ["CI", None, "ID"]


def test_dot_segments_at_any_depth(spark):
    cases = {
        "/1/2/3/4/5/6/../../../../x": "/1/2/x",
        "/1/2/3/4/5/6/7/8/9/10/11/" + "../" * 10 + "x": "/1/x",
        "/a/./b/": "/a/b/",
        "/a/b/..": "/a/",
        "/../x": "/x",
        "/a//b/../c": "/a//c",
        "/a/.hidden/..x": "/a/.hidden/..x",
    }
    df = spark.createDataFrame([(p,) for p in cases], "p string")
    assert {r[0]: r[1] for r in df.select("p", html._drop_dots(F.col("p"))).collect()} == cases


def test_references(spark):
    cases = {
        "Caf&uuml;e &#8220;x&#8221; &#x27;": "Cafüe “x” '",
        "&amp;lt; &lt; &#38;gt; &gt;": "&lt; < &gt; >",
        "&nope; &#55296; &#9999999; & &;": "&nope; &#55296; &#9999999; & &;",
        "&#x1F600;&apos;": "\U0001f600'",
    }
    df = spark.createDataFrame([(p,) for p in cases], "p string")
    assert {r[0]: r[1] for r in df.select("p", html.decode_entities(F.col("p"))).collect()} == cases


def test_compatibility_forms(spark):
    df = spark.createDataFrame([("Swiss Water™ ½ lb Ⅷ ㎏ \U0001d400bc",)], "p string")
    assert df.select(text.normalize_text(F.col("p"))).first()[0] == "swiss watertm 1 2 lb viii kg abc"


def test_references_are_read_alike_by_both_ways(spark):
    """Texts whose references are all usual ones go a shorter way; the others' table is a constant, not made for each row."""
    usual = {"a &amp; b": "a & b", "&am&amp;p; x": "&am&p; x", "&amp;lt;&lt;": "&lt;<", "&#39;&quot;&nbsp;&gt;&apos;": "'\" >'", "none": "none"}
    others = {"&eacute;&amp;#39;": "é&#39;", "&#x41;&lt;": "A<", "& &&amp;": "& &&", "&bogus; &amp;": "&bogus; &", "&amp": "&amp"}
    assert {t: one(spark, html.decode_entities, t) for t in usual | others} == usual | others
    plan = spark.createDataFrame([("x",)], "t string").select(html.decode_entities(F.col("t")))
    assert "map_from_arrays(" not in plan._jdf.queryExecution().optimizedPlan().toString()


@pytest.mark.parametrize("patterns", [[p for p, _ in r] for r in (rules.ROAST_RULES, rules.PROCESS_RULES, rules.VARIETY_RULES)] + [[r"\bab|cd", r"\bx\b"], ["a[|]b", "c"]])
def test_one_pattern_for_several(spark, patterns):
    rnd = random.Random(5)
    words = "gesha sl 28 sl28 bourbon barrel mundo novo wet hulled honey process natural naturally omni medium dark light city xcd ab a|b c x geshas".split()
    texts = [" ".join(rnd.choices(words, k=rnd.randint(0, 5))) for _ in range(300)]
    some, single = F.col("t").rlike(text.any_of(patterns)), [F.col("t").rlike(p) for p in patterns]
    found = spark.createDataFrame([(t,) for t in texts], "t string").select("t", some.alias("some"), F.array_contains(F.array(*single), True).alias("any"))
    assert [r.t for r in found.collect() if r["some"] != r["any"]] == []
    assert text.any_of([r"(a)\1", "b"]) is None and text.any_of(["a"]) is None


def test_computed_columns_are_compiled(spark):
    """Array functions would make a generator run uncompiled: they are worked out before it."""
    df = computed(spark.createDataFrame([("A",)], "t string"), low=text.trim_all(F.lower("t")))
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert not [line for line in plan.splitlines() if "Generate" in line and "lambda" in line]
    assert [tuple(r) for r in df.collect()] == [("A", "a")]


def test_gazetteer_builds_only_runs_that_can_match(spark):
    places = as_lexicon(spark.createDataFrame([("Costa Rica", "CR"), ("Peru", "PE")], "phrase string, value string"))
    texts = spark.createDataFrame([(i, t) for i, t in enumerate(["from costa rica and peru", "costa", "rica costa", "peruvian", None, ""])], "id long, t string")
    hits = gazetteer_matches(texts, "id", F.col("t"), places)
    assert sorted(tuple(r) for r in hits.select("id", "start", "size", "value").collect()) == [(0, 1, 2, "CR"), (0, 4, 1, "PE")]
    assert "LeftSemi" in hits._jdf.queryExecution().optimizedPlan().toString()
