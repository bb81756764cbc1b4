"""Runs of a small region through the whole plan."""

import datetime
import json

from pyspark.sql import functions as F

from cartolex.operators.report import report_markdown
from cartolex.plans.refresh import Inputs, refresh_region
from cartolex.session import durable
from cartolex.sources.dims import ADD_SCHEMA, PATCH_SCHEMA, country_lexicon, note_lexicon, read_dim

FLAT = (
    "id string, name string, category string, alternates array<string>, confidence double, websites array<string>, "
    "socials array<string>, phones array<string>, brand string, street string, locality string, region string, "
    "postcode string, operating_status string, lng double, lat double"
)
LONG = "This page says quite a lot about what the shop has on its shelves today."


def place(id, name, lng=-71.1, lat=42.3, confidence=0.9, site="https://shop.example.com"):
    return (id, name, "cafe", [], confidence, [site] if site else [], [], ["555"], None, "1 Main", "Boston", "US-MA", "02139", None, lng, lat)


def catalogue(*titles):
    return json.dumps(
        {
            "products": [
                {"title": t, "handle": t.lower().replace(" ", "-"), "product_type": "Coffee", "tags": ["light roast"],
                 "body_html": "<p>Tasting notes: Strawberry jam, cedar</p>",
                 "variants": [{"title": "12 oz", "price": "20.00", "available": True}]}
                for t in titles
            ]
        }
    )


def run(spark, day, places, pages, responses=(), before=None, complete=True, add=(), hide=(), budget=400):
    before = before or {}
    t = Inputs(
        flat=spark.createDataFrame(places, FLAT),
        crawls=spark.createDataFrame([(p[0], "ok" if p[5] else "no-site", "shopify" if p[0] == "a" else "other") for p in places], "id string, status string, platform string"),
        pages=spark.createDataFrame(pages, "id string, pos int, url string, kind string, text string, hash string"),
        responses=spark.createDataFrame(list(responses), "id string, response string"),
        deny=spark.createDataFrame([("Big Chain",)], "phrase string"),
        hide=spark.createDataFrame([(h,) for h in hide], "id string"),
        patch=read_dim(spark, [("b", "Bee Cafe", None, None, None)], PATCH_SCHEMA),
        add=read_dim(spark, add, ADD_SCHEMA),
        notes=note_lexicon(spark),
        countries=country_lexicon(spark),
        **{k: before[k] for k in ("state", "items", "menu", "index") if k in before},
    )
    out = refresh_region(t, "boston", F.lit(datetime.datetime(2024, 1, day)), complete, budget)
    return {k: durable(v) for k, v in out.items()}


def by_id(df, column, key="id"):
    return {r[key]: r[column] for r in df.collect()}


def page(id, pos, kind, text):
    return (id, pos, "https://shop.example.com/" + kind, kind, text, str(hash(text)))


def test_three_runs(spark):
    places = [
        place("a", "Alpha"),
        place("a2", "alpha!", lng=-71.1001, confidence=0.6),
        place("b", "Bee", lng=-71.2),
        place("c", "Big Chain Main St", lng=-71.3),
        place("d", "Delta", lng=-71.4, site=None),
    ]
    pages = [
        page("a", 0, "home", LONG),
        page("a", 1, "products-json", catalogue("Ethiopia Guji", "House Blend", "Logo Mug")),
        page("a", 2, "menu", LONG + " menu"),
        page("b", 0, "home", LONG + " bee"),
    ]
    answers = [
        ("a", json.dumps({"menu": [{"name": "Latte", "category": "espresso", "priceUsd": 4.5}]})),
        ("b", json.dumps({"beans": [{"name": "Kenya AA", "countries": ["KE"], "notes": ["rose"], "priceUsd": 2}]})),
    ]
    manual = [("manual-z", "boston", "Zed", "both", 42.0, -71.0, "2 Main", "zed.example.com")]
    one = run(spark, 1, places, pages, answers, add=manual)
    assert by_id(one["drops"], "reason") == {"a2": "duplicate", "c": "chain"}
    assert by_id(one["actions"], "action") == {k: "created" for k in ("a", "b", "d", "manual-z")}
    index = {r.id: r for r in one["index"].collect()}
    assert (index["a"].kind, index["a"].data_status, index["a"].bean_count) == ("both", "beans", 2)
    assert index["a"].origin_countries == ["ET"] and index["a"].roast_levels == ["light"]
    assert index["a"].flavor_families == ["fruity/berry", "other"]
    assert (index["b"].name, index["b"].kind, index["b"].bean_count) == ("Bee Cafe", "cafe", 1)
    assert index["d"].data_status == "none"
    assert {(r.priority, r.id, r.mode) for r in one["jobs"].collect()} == {(2, "a", "menu"), (3, "b", "both")}
    document = one["documents"].filter("id = 'a'").first()
    assert [i.name for i in document["items"]] == ["Ethiopia Guji", "House Blend"]
    assert [d.name for d in document.dishes] == ["Latte"] and not document.trimmed

    # A drops one item, b disappears, d is renamed.
    later = [p for p in places if p[0] != "b"]
    later[-1] = place("d", "Delta Two", lng=-71.4, site=None)
    pages2 = [page("a", 0, "home", LONG), page("a", 1, "products-json", catalogue("Ethiopia Guji"))]
    two = run(spark, 2, later, pages2, (), one, add=manual)
    assert by_id(two["actions"], "action") == {"a": "updated", "b": "hidden", "d": "updated", "manual-z": "carried"}
    assert sorted(r.misses for r in two["items"].filter("entity_id = 'a'").collect()) == [0, 1]
    assert by_id(two["state"], "hidden_runs")["b"] == 1
    assert two["menu"].count() == 0  # no menu page any more, so the menu is gone
    text = report_markdown("boston", two["report"], {"Skipped": two["skipped"].select("id")})
    assert "- **publish:**" in text and "hidden 1" in text

    # A partial run with the same pages: nothing is extracted again, vanished places stay as they are.
    three = run(spark, 3, later, pages2, (), two, complete=False, add=manual)
    assert by_id(three["actions"], "action") == {"a": "carried", "b": "kept", "d": "carried", "manual-z": "carried"}
    assert by_id(three["state"], "hidden_runs")["b"] == 1
    assert three["jobs"].count() == 0


def test_call_budget_is_retried(spark):
    places = [place("a", "Alpha"), place("b", "Bee", lng=-71.2)]
    pages = [page("a", 0, "home", LONG), page("b", 0, "home", LONG + " b")]
    out = run(spark, 1, places, pages, (), budget=1)
    assert [r.id for r in out["skipped"].collect()] == ["b"]
    assert set(by_id(out["state"], "pages_hash").values()) == {""}
