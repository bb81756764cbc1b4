"""Map clusters against a step-by-step greedy model."""

import random

import pytest
from pyspark.sql import functions as F

from cartolex.operators.pyramid import WORLD, cluster_pyramid, greedy_clusters, map_spots, radius_at


def greedy(items, radius):
    """Owner of each item; ``items`` are (order, id, x, y)."""
    centres, owner = [], {}
    for _, id, x, y in sorted(items):
        near = [c for c, a, b in centres if (a - x) ** 2 + (b - y) ** 2 <= radius * radius]
        if not near:
            centres.append((id, x, y))
        owner[id] = near[0] if near else id
    return owner


def ordered(spark, rows):
    df = spark.createDataFrame(rows, "id string, points bigint, x bigint, y bigint")
    return df, [tuple(r) for r in df.select(F.xxhash64("id"), "id", "x", "y").collect()]


@pytest.mark.parametrize(("seed", "span", "tile", "halo"), [(1, 3_000, 32, 8), (2, 12_000, 4, 2), (3, 60_000, 2, 2)])
def test_same_as_greedy(spark, seed, span, tile, halo):
    rnd = random.Random(seed)
    rows = [(f"p{i}", 1, rnd.randrange(span), rnd.choice([rnd.randrange(span), WORLD - 1 - rnd.randrange(span)])) for i in range(900)]
    rows += [(f"s{i}", 2, 700, 700) for i in range(30)]
    df, items = ordered(spark, rows)
    got = {r["id"]: r["owner"] for r in greedy_clusters(df, 1000, tile, halo).collect()}
    assert got == greedy(items, 1000)


def test_levels_follow_from_each_other(spark):
    rnd = random.Random(5)
    towns = [(rnd.uniform(-180, 180), rnd.uniform(-85, 85)) for _ in range(12)]
    rows = [(i, *(a + rnd.gauss(0, 0.02) for a in rnd.choice(towns))) for i in range(600)] + [(1000 + i, 179.999 + i, 89.0) for i in range(3)]
    rows += [(2000, None, 1.0), (2001, 1.0, None), (None, 1.0, 1.0), (2002, 7.25, 46.5), (2003, 7.25, 46.5)]
    df = spark.createDataFrame(rows, "id bigint, lng double, lat double")
    got = [r.asDict() for r in cluster_pyramid(df, "id", F.col("lng"), F.col("lat"), max_zoom=9).collect()]
    spots = map_spots(df, "id", F.col("lng"), F.col("lat"), radius_at(9) // 16)
    order = dict(spots.select("id", F.xxhash64("id")).collect())
    items = {r["id"]: (r["points"], r["x"], r["y"]) for r in spots.collect()}
    assert sum(n for n, _, _ in items.values()) == 605
    parents = {}
    for zoom in range(9, -1, -1):
        owner = greedy([(order[i], i, x, y) for i, (_, x, y) in items.items()], radius_at(zoom))
        if zoom < 9:
            assert parents == owner
        merged = {}
        for i, (n, x, y) in items.items():
            m = merged.setdefault(owner[i], [0, 0, 0])
            m[0], m[1], m[2] = m[0] + n, m[1] + n * x, m[2] + n * y
        items = {i: (n, x // n, y // n) for i, (n, x, y) in merged.items()}
        level = [r for r in got if r["zoom"] == zoom]
        assert {r["cluster_id"]: r["points"] for r in level} == {i: n for i, (n, _, _) in items.items()}
        assert all(abs((r["lng"] + 180) / 360 * WORLD - items[r["cluster_id"]][1] - 0.5) < 0.01 for r in level)
        parents = {r["cluster_id"]: r["parent_id"] for r in level}
    assert set(parents.values()) == {None}


def test_empty(spark):
    df = spark.createDataFrame([], "id string, lng double, lat double")
    assert cluster_pyramid(df, "id", F.col("lng"), F.col("lat"), max_zoom=2).collect() == []
