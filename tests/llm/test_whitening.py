"""Whitening against a dense eigendecomposition."""

import math
import os

import numpy as np
import pytest

from cartolex.llm import queries as q
from cartolex.llm.common import table
from cartolex.llm.whitening import leading, whiten

SCHEMA = "vec_id long, embedding array<float>, n string, component string, v array<long>"
FOLDER = os.environ.get("LLM_SF_DIR", "/root/testdata/sf0.001")


def check(got, vectors, wanted, scale=64):
    """``vectors``: (id, list) of the rows that count. Signs of components are free, but one for all rows."""
    width = max(len(v) for _, v in vectors)
    x = np.array([[math.floor(scale * float(np.float32(c))) for c in v] + [0] * (width - len(v)) for _, v in vectors], object)
    n, sums = len(x), x.sum(0)
    c = np.array(x - sums[None] / n, float)
    values, basis = np.linalg.eigh(c.T @ c / n)
    trace = values.sum()
    values, basis = values[::-1][:wanted], basis[:, ::-1][:, :wanted]
    k = int((values > 1e-12 * trace).sum())
    want = c @ basis[:, :k] / np.sqrt(values[:k])
    deviation = ((n * x - sums[None]) ** 2).sum(1)
    rows = sorted(got.collect(), key=lambda r: (r.component, str(r.vec_id), r.whitened))
    assert len(rows) == n * k and {r.component for r in rows} == set(range(1, k + 1))
    ids = [i for i, _ in vectors]
    for j in range(k):
        own = rows[j * n : (j + 1) * n]
        signs = []
        for sign in (1, -1):
            plain = sorted(zip(map(str, ids), sign * want[:, j], deviation, strict=True), key=lambda r: (r[0], r[1]))
            signs.append(all(str(r.vec_id) == i and abs(r.whitened - w) < 1e-6 and r.deviation == d for r, (i, w, d) in zip(own, plain, strict=True)))
        assert any(signs)
        assert all(r.n == n and abs(r.explained / (values[j] / trace) - 1) < 1e-9 and r.identity_error < 1e-9 for r in own)


def test_op11(spark):
    got = q.QUERIES["op11_whitening"](spark, FOLDER)
    assert got.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    check(got, [(r.vec_id, r.embedding) for r in table(spark, FOLDER, "embeddings").collect()], 32)


def test_odd_vectors(spark):
    rng = np.random.default_rng(2)
    fine = [(i, rng.standard_normal(12).round(3).tolist()) for i in range(60)]
    fine += [(60, [1.0] * 5), (61, []), (None, [0.5] * 12), (7, fine[7][1]), (7, fine[7][1]), (62, [0.0] * 12)]
    bad = [(70, None), (71, [1.0, None]), (72, [float("nan")] * 12), (73, [float("inf")]), (None, None)]
    rows = [(i, v, "x", None, [1]) for i, v in [*fine, *bad]]
    got = whiten(spark.createDataFrame(rows, SCHEMA).repartition(3), components=5, guard=2)
    check(got, fine, 5)


def test_nothing_to_whiten(spark):
    for rows in ([], [(1, [1.0, 2.0])], [(1, [3.0, 4.0]), (2, [3.0, 4.0])], [(1, [])], [(1, None)]):
        assert whiten(spark.createDataFrame([(*r, None, None, None) for r in rows], SCHEMA)).count() == 0


def test_fewer_directions_than_components(spark):
    rng = np.random.default_rng(3)
    rows = [(i, [float(a), float(2 * a), 0.0, float(b)]) for i, (a, b) in enumerate(rng.integers(-9, 9, (30, 2)))]
    got = whiten(spark.createDataFrame(rows, "vec_id long, embedding array<double>"))
    assert {r.component for r in got.collect()} == {1, 2}
    check(got, rows, 32)


def test_deviation_beyond_64_bits(spark):
    rows = [(1, [1e30, 0.0]), (2, [-1e30, 1.0]), (3, [0.25, 2.0])]
    got = whiten(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), components=1)
    assert [r.deviation for r in got.orderBy("vec_id").collect()][:2] == [None, None] and got.count() == 3


def matrix(values, seed=0):
    basis = np.linalg.qr(np.random.default_rng(seed).standard_normal((len(values), len(values))))[0]
    return basis * values @ basis.T


SPECTRA = {
    "flat": 60 + 10 * np.random.default_rng(1).random(200),
    "steep": 10.0 ** -np.linspace(0, 9, 200),
    "outliers": np.concatenate([[1e6, 1e5], 50 + np.random.default_rng(2).random(198)]),
    "long tail below": np.concatenate([np.linspace(2, 3, 150), np.linspace(0, 1, 50)]),
    "plateaus": np.concatenate([np.full(10, 9.0), np.full(100, 5.0), np.full(90, 1.0)]),
    "few": np.concatenate([np.arange(1, 6), np.zeros(195)]).astype(float),
}


@pytest.mark.parametrize("name", SPECTRA)
def test_leading(name):
    """The whole filter on matrices much wider than the block."""
    values = np.sort(SPECTRA[name])[::-1]
    v = matrix(values)
    calls = []

    def apply(block):
        calls.append(block.shape[1])
        return v @ block

    got, basis = leading(apply, len(values), 20)
    assert np.abs(got - values[:20]).max() <= 1e-12 * values[0]
    assert np.abs(basis.T @ basis - np.eye(20)).max() < 1e-12
    assert np.linalg.norm(v @ basis - basis * got, axis=0).max() <= 1e-9 * values[0]
    assert max(calls) < len(values) or name in ("flat", "plateaus", "long tail below", "few")
    assert len(calls) < 300


def test_block_smaller_than_space_in_the_query(spark):
    """64 dimensions and 32 components: the block has 48 vectors, and the filter does the rest."""
    seen = []
    v = matrix(np.linspace(58, 70, 64))
    values, _ = leading(lambda b: (seen.append(b.shape[1]), v @ b)[1], 64, 32)
    assert max(seen) == 48 and len(seen) < 60
    assert np.abs(values - np.linspace(70, 58, 64)[:32]).max() < 1e-11
