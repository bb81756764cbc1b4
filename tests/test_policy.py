"""Crawl rules with wildcards against regular expressions."""

import random
import re

from cartolex.operators.corpus import policy_join


def pattern(rule):
    body, end = (rule[:-1], "$") if rule.endswith("$") else (rule, "")
    return re.compile("^" + ".*".join(map(re.escape, body.split("*"))) + ("\\Z" if end else ""))


def test_against_regular_expressions(spark):
    rng = random.Random(2)
    word = lambda n: "".join(rng.choice("/ab?$é") for _ in range(n))
    urls = [(i, f"https://www.h{i % 3}.example/{word(rng.randrange(9))}") for i in range(400)]
    rules = sorted({(f"h{h}.example", "/" * rng.randrange(2) + "".join(rng.choice("/ab?é*") for _ in range(rng.randrange(6))) + rng.choice(["", "", "$", "*"]), rng.random() < 0.5) for h in range(3) for _ in range(25)})
    rules += [("h0.example", "/*", False), ("h1.example", "*$", False), ("h2.example", "/$", False)]
    out = policy_join(spark.createDataFrame(urls, "id long, url string"), "id", "url", spark.createDataFrame(rules, "host string, prefix string, allow boolean"))
    want = {}
    for i, url in urls:
        path = re.sub("^https://[^/]*", "", url)
        met = [(len(r.encode()), a) for h, r, a in rules if h == f"h{i % 3}.example" and pattern(r).search(path)]
        want[i] = max(met)[1] if met else True
    assert {r.id: r.allowed for r in out.collect()} == want
    assert "CartesianProduct" not in out._jdf.queryExecution().toString() and "NestedLoop" not in out._jdf.queryExecution().toString()
