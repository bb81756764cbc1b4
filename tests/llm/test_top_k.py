"""Searches against all inner products."""

import math
import random

import numpy as np
import pyarrow as pa
import pytest

from cartolex.llm.top_k import NONE, Tree, _bounds, _cells, _routes, top_k

SCHEMA = "vec_id long, embedding array<float>, score string, rank string"


def brute(rows, k, scale):
    fine = [(i, [math.floor(scale * float(np.float32(x))) for x in v]) for i, v, *_ in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    asked = {}
    for i, v in fine:
        if i % 3 == 0:
            asked[i] = min(asked.get(i, v), v)
    out = []
    for i, q in asked.items():
        scores = sorted((-sum(a * b for a, b in zip(q, v, strict=False)), j) for j, v in fine if j != i)[:k]
        out += [(i, n + 1, j, -s) for n, (s, j) in enumerate(scores)]
    return sorted(out)


def rows(seed, n, dims, spread=1.0):
    rnd = random.Random(seed)
    centres = [[rnd.gauss(0, spread) for _ in range(dims)] for _ in range(5)]
    out = [(i * 7 % 1009, [c + rnd.gauss(0, 0.3) for c in rnd.choice(centres)], "x", None) for i in range(n)]
    return out + [(2000 + i, out[0][1], "x", None) for i in range(40)]


@pytest.mark.parametrize(("seed", "k", "shard_rows"), [(1, 20, 10**6), (2, 5, 90), (3, 20, 40)])
def test_against_all(spark, seed, k, shard_rows):
    data = rows(seed, 400, 8)
    df = spark.createDataFrame(data, SCHEMA).repartition(3)
    got = top_k(df, df.filter("vec_id % 3 = 0"), k, 64, shard_rows).collect()
    assert sorted(map(tuple, got)) == brute(data, k, 64)


def test_odd_rows(spark):
    data = [*rows(4, 60, 4), (None, [1.0] * 4, "x", "y"), (3001, None, "x", "y"), (3003, [1.0, None, 1.0, 1.0], "x", "y"), (3006, [float("nan")] * 4, "x", "y"), (3009, [float("inf"), 0.0, 0.0, 0.0], "x", "y"), (3012, [], "x", "y"), (3015, [0.5, 2.0], "x", "y"), (3018, [0.0] * 4, "x", "y"), (3, [9.0] * 4, "x", "y"), (3, [9.0] * 4, "x", "y")]
    df = spark.createDataFrame(data, SCHEMA)
    got = top_k(df, df.filter("vec_id % 3 = 0"), 20, 64, 25).collect()
    assert sorted(map(tuple, got)) == brute(data, 20, 64)


def test_large_numbers_are_exact(spark):
    data = [(i, [float(2**24 + i * 2), -1.0 - i, 3.0], "x", "y") for i in range(0, 60)]
    df = spark.createDataFrame(data, SCHEMA)
    got = top_k(df, df.filter("vec_id % 3 = 0"), 4, 32, 20).collect()
    assert sorted(map(tuple, got)) == brute(data, 4, 32)


def test_few_rows(spark):
    df = spark.createDataFrame([(3, [1.0], "x", "y"), (4, [2.0], "x", "y")], SCHEMA)
    assert [tuple(r) for r in top_k(df, df.filter("vec_id = 3")).collect()] == [(3, 1, 4, 64 * 128)]
    assert top_k(df.limit(0), df.limit(0)).collect() == []


def test_bounds_hold_and_prune():
    rng = np.random.default_rng(1)
    vectors = (rng.normal(size=(8000, 6)) * 40).round() + rng.integers(-4, 5, size=(8000, 1)) * 100
    tree = Tree(np.arange(8000), vectors)
    queries = (rng.normal(size=(20, 6)) * 50).round()
    for (a, b), centre, radius in zip(tree.spans, tree.centres, tree.radii, strict=True):
        assert (_bounds(queries, centre, radius) >= (queries @ tree.vectors[a:b].T).max(1)).all()
    leaves = (tree.below < 0).sum()
    scores, found = tree.search(np.full(20, -1), queries, np.full(20, NONE), 5)
    assert tree.visited < 0.7 * 20 * leaves
    products = (queries @ vectors.T).astype(int)
    assert (scores == -np.sort(-products, 1)[:, :5]).all()
    # With the k-th score known from elsewhere, no more is opened than before, and the same is found.
    before, tree.visited = tree.visited, 0
    again, ids = tree.search(np.full(20, -1), queries, scores[:, 4].copy(), 5)
    assert tree.visited <= before and (again == scores).all() and (ids == found).all()


def test_cells_are_not_asked_in_vain(spark):
    rnd = random.Random(9)
    towns = [[500.0, 0, 0], [0, 500.0, 0], [0, 0, 500.0], [-500.0, 0, 0]]
    data = [(i, [c + rnd.gauss(0, 1) for c in towns[0 if i % 3 else rnd.randrange(4)]], "x", "y") for i in range(400)]
    centres = _cells(np.array([np.floor(np.array(v) * 64) for _, v, *_ in data]), 8)
    assert len(centres) == 8
    routes = _routes(3, centres, np.full(8, 640.0), np.arange(8), np.ones(8, int), False)
    batch = pa.RecordBatch.from_arrays([pa.array([1]), pa.array([[32000, 0, 0]]), pa.array([31000 * 32000])], ["id", "v", "least"])
    assert sum(b.num_rows for b in routes([batch])) < 7
    df = spark.createDataFrame(data, SCHEMA)
    assert sorted(map(tuple, top_k(df, df.filter("vec_id % 3 = 0"), 6, 64, 30).collect())) == brute(data, 6, 64)


def test_equal_vectors_fill_one_cell(spark):
    data = [(i, [1.0, 2.0], "x", "y") for i in range(200)]
    df = spark.createDataFrame(data, SCHEMA)
    assert sorted(map(tuple, top_k(df, df.filter("vec_id % 3 = 0"), 4, 64, 16).collect())) == brute(data, 4, 64)
