"""Radius de-duplication against a step-by-step greedy model."""

import math
import random

import pytest
from pyspark.sql import functions as F

from cartolex.operators.dedupe import nearest_anchor, spatial_dedupe


def meters(a, b):
    la, lb = math.radians(a[1]), math.radians(b[1])
    h = math.sin((lb - la) / 2) ** 2 + math.cos(la) * math.cos(lb) * math.sin(math.radians(b[0] - a[0]) / 2) ** 2
    return 2 * 6371000 * math.asin(min(1, math.sqrt(h)))


def greedy(points, radius):
    kept = []
    for p in sorted(points, key=lambda p: (p[4], p[0])):
        if not any(k[1] == p[1] and meters(k[2:4], p[2:4]) <= radius for k in kept):
            kept.append(p)
    return kept


def run(spark, points, radius=50.0):
    df = spark.createDataFrame(points, "id int, k string, lng double, lat double, pr int")
    by = (F.col("k"), F.col("lng"), F.col("lat"), [F.col("pr")], radius)
    return spatial_dedupe(df, "id", *by), by


@pytest.mark.parametrize("seed, lat", [(1, 42.0), (2, 89.9), (3, -33.0)])
def test_same_as_greedy(spark, seed, lat):
    rnd = random.Random(seed)
    points = [
        (i, rnd.choice("ab"), 179.999 + rnd.randint(0, 200) / 1e5, lat + rnd.randint(0, 300) / 1e5, rnd.randint(0, 3))
        for i in range(250)
    ]
    points = [(i, k, x - 360 if x > 180 else x, y, p) for i, k, x, y, p in points]
    judged, _ = run(spark, points)
    assert {r.id for r in judged.filter("kept").collect()} == {p[0] for p in greedy(points, 50.0)}


def test_near_a_dropped_row_only_stays(spark):
    # About 40 m apart in a row: the middle falls to the first, the last is 80 m from the first.
    points = [(1, "a", 0.0, 0.0, 0), (2, "a", 0.00036, 0.0, 1), (3, "a", 0.00072, 0.0, 2)]
    judged, by = run(spark, points)
    assert {r.id: r.kept for r in judged.collect()} == {1: True, 2: False, 3: True}
    links = nearest_anchor(judged.filter("NOT kept"), judged.filter("kept"), "id", *by)
    assert [tuple(r) for r in links.collect()] == [(2, 1)]


def test_many_copies_of_one_spot(spark):
    judged, _ = run(spark, [(i, "a", 1.0, 2.0, 0) for i in range(500)] + [(500, "b", 1.0, 2.0, 9)])
    assert sorted(r.id for r in judged.filter("kept").collect()) == [0, 500]


def test_empty(spark):
    judged, _ = run(spark, [])
    assert judged.count() == 0


def test_rising_priorities_end_in_a_few_rounds(spark, monkeypatch):
    # Two thousand spots 40 m apart, each better than the one before: only one is a local best at a time.
    from cartolex.operators import dedupe

    rounds = []
    durable = dedupe.durable
    monkeypatch.setattr(dedupe, "durable", lambda df: rounds.append(1) or durable(df))
    points = [(i, "a", i * 0.00036, 0.0, 2000 - i) for i in range(2000)]
    judged, _ = run(spark, points)
    assert {r.id for r in judged.filter("kept").collect()} == {p[0] for p in greedy(points, 50.0)}
    assert len(rounds) <= 6
