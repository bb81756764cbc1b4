"""Rules and parts of urls against plain Python; templates on urls whose good and bad branches are known."""

import random

from cartolex.llm import url_filter as u

SCHEMA = "page_id long, url string, host string, rule string"
RULES = [("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow")]


def plain(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    end = min([rest.find(c) for c in "/?#" if c in rest] or [len(rest)])
    host, rest = rest[:end], rest[end:]
    host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host)
    return host, rest[: min([rest.find(c) for c in "?#" if c in rest] or [len(rest)])]


def rule(host, path):
    fit = [(len(t), t, v) for t, v in RULES for own, _, rest in [t.partition("/")] if (host == own or host.endswith("." + own)) and path.startswith("/" + rest)]
    return max(fit)[1:] if fit else (None, None)


def test_rules_and_parts(spark):
    rnd = random.Random(1)
    bits = ["http", "://", "/", "?", "#", "example", ".net", ".com", ".org", "net", "EN", "en", "fr", "de", "İ", "\n", "É", ".", "a", "12"]
    urls = ["".join(rnd.choice(bits) for _ in range(rnd.randint(0, 9))) for _ in range(400)]
    urls += [f"https://{h}{p}" for h in ("example.net", "a.example.net", "b.net", "notexample.com", "Example.COM", "x.org", "org", "net") for p in ("", "/", "/en/1", "/en", "/de/x?y", "/fr/#", "?/fr/", "/fr/../")]
    urls += [None, "", "://", "x://net/://org/fr/", "http://net/" + "y/" * 20_000]
    rows = [(i, x, "x", None) for i, x in enumerate(urls)] + [(0, "http://net/", "x", None), (None, "http://org/fr/", "x", None)]
    none = spark.createDataFrame([], "page_id long, good boolean")
    got = u.judge_urls(spark.createDataFrame(rows, SCHEMA).repartition(3), none, RULES).collect()
    want = []
    for i, x, *_ in rows:
        host, path = plain(x)
        own, says = rule(host, path)
        want.append((i, host, path, own, says or "allow"))
    assert sorted(((r.page_id, r.host, r.path, r.rule, r.verdict) for r in got), key=repr) == sorted(want, key=repr)


def test_templates(spark):
    rnd = random.Random(2)
    pages, labels = [], []
    for i in range(1500):
        part, good = rnd.choice([("news", 0.9), ("blog", 0.88), ("spam", 0.05), ("ads", 0.08)])
        host = rnd.choice(["a.example", "b.example"])
        pages.append((i, f"http://{host}/{part}/{rnd.randrange(10**6)}/{'x' if rnd.random() < 0.5 else 'y'}.html", "x", "x"))
        if rnd.random() < 0.5:
            labels.append((i, rnd.random() < good))
    labels += [(None, True), (5, None)]
    df = spark.createDataFrame(pages, SCHEMA)
    got = u.judge_urls(df, spark.createDataFrame(labels, "page_id long, good boolean"), []).collect()
    assert len(got) == len(pages)
    for r in got:
        assert r.verdict == ("allow" if "/news/" in r.path or "/blog/" in r.path else "block"), r
    # Alike branches are one template, and the numbers in it are wildcards.
    assert len({r.template for r in got}) <= 8
    assert all("*" in r.template for r in got)


def test_wide_branching_is_a_wildcard(spark):
    pages = [(i, f"http://h.example/user{chr(97 + i % 26)}{chr(97 + i // 26)}", "x", "x") for i in range(300)]
    got = u.judge_urls(spark.createDataFrame(pages, SCHEMA), spark.createDataFrame([(1, True)], "page_id long, good boolean"), [], children=20).collect()
    assert {r.template for r in got} == {"h.example/*"}


def judged(spark, parts, **options):
    """Verdicts by part of a path on one host: ``parts`` has (part, pages, labelled, good) each."""
    pages, labels = [], []
    for part, n, labelled, good in parts:
        for j in range(n):
            if j < labelled:
                labels.append((len(pages), j < good))
            pages.append((len(pages), f"http://h.example/{part}", "x", "x"))
    got = u.judge_urls(spark.createDataFrame(pages, SCHEMA), spark.createDataFrame(labels, "page_id long, good boolean"), [], **options).collect()
    assert len(got) == len(pages)
    return {p: {(r.verdict, r.template) for r in got if r.path == f"/{p}"} for p, *_ in parts}


def test_children_with_few_labels_do_not_bridge(spark):
    got = judged(spark, [("spam", 400, 400, 20), ("misc", 5, 0, 0), ("few", 5, 2, 1), ("news", 400, 400, 380), ("", 5, 0, 0)])
    assert {v for v, _ in got["spam"]} == {"block"} and {v for v, _ in got["news"]} == {"allow"}
    assert len({t for found in got.values() for _, t in found}) == 4  # misc and few are one


def test_a_chain_of_alike_neighbours_is_split(spark):
    got = judged(spark, [(f"p{chr(97 + i)}", 60, 60, 6 * i) for i in range(11)])
    assert {v for v, _ in got["pa"] | got["pb"]} == {"block"} and {v for v, _ in got["pj"] | got["pk"]} == {"allow"}
    assert got["pa"] != got["pk"]


def test_children_of_a_wide_branching_are_judged(spark):
    users = [(f"u{chr(97 + i % 26)}{chr(97 + i // 26)}", 3, i % 2, i % 4 == 1) for i in range(200)]
    for extra in ([], [("7", 300, 300, 290)]):
        got = judged(spark, [("spam", 300, 300, 12), ("news", 300, 300, 290), *users, *extra])
        assert {v for v, _ in got["spam"]} == {"block"} and {v for v, _ in got["news"]} == {"allow"}
        rest = {t for p, *_ in users for _, t in got[p]}
        assert len(rest) == 1 and not rest & {t for p in ("spam", "news", *(p for p, *_ in extra)) for _, t in got[p]}


def test_deep_branches_are_judged(spark):
    deep = "shop/en/items/all/by/name/"
    got = judged(spark, [(deep + "spam/x", 300, 300, 12), (deep + "news/x", 300, 300, 290), (deep + "misc/x/y/z", 5, 0, 0), ("y/" * 5000, 3, 0, 0)])
    assert {v for v, _ in got[deep + "spam/x"]} == {"block"} and {v for v, _ in got[deep + "news/x"]} == {"allow"}
    got = judged(spark, [(deep + "spam/x", 30, 30, 1), (deep + "news/x", 30, 30, 29)], depth=3)
    assert {t for found in got.values() for _, t in found} == {"h.example/shop/en/**"}


def test_empty_table(spark):
    none = spark.createDataFrame([], "page_id long, good boolean")
    assert u.judge_urls(spark.createDataFrame([], SCHEMA), none, RULES).collect() == []
