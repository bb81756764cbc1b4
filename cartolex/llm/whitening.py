"""Whitened embeddings: the leading eigenvectors of the covariance by Chebyshev-filtered subspace iteration.

The covariance is never built. A pass over the rows gives V Q for a block Q of a few more vectors than are wanted: each task
centres its rows, multiplies them with Q and the result with the rows again, and the products of the tasks are summed. Some
Lanczos steps find how far the spectrum reaches down; a Chebyshev polynomial that stays small on the part below the block
damps that part, degree by degree, one pass each. The block is made orthonormal again (QR), rotated to its own eigenvectors
(Rayleigh-Ritz), and certified by its residuals; if they do not fall, the block grows.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cartolex.llm.common import ship, stored

#: Vectors of the block beyond those wanted.
GUARD = 16
#: Steps that look for the lower end of the spectrum.
STEPS = 10
#: Highest degree between two orthonormalisations, and how far (powers of ten) the largest eigenvalue may outgrow the last wanted.
DEGREE, SPREAD = 20, 8.0
#: Residuals, as parts of the largest eigenvalue: certified below the first; below the second they may have reached rounding.
CERTAIN, ROUNDED = 1e-14, 1e-10
#: Eigenvalues below this part of the trace count as zero.
FLAT = 1e-13
#: Largest magnitude of an entry: beyond it, and far above any embedding, entries are clipped.
CLIP = 2**52
#: Bytes of partial products that the driver adds up itself.
DRIVER_BYTES = 1 << 25

SUM = "block binary"
OUT = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"


def _matrix(column, width: int) -> np.ndarray:
    """Lists as rows, shorter ones filled with zeros."""
    sizes = column.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    values = column.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    if (sizes == width).all():
        return values.reshape(-1, width)
    out = np.zeros((len(sizes), width), np.int64)
    rows = np.repeat(np.arange(len(sizes)), sizes)
    out[rows, np.arange(len(values)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = values
    return out


def _blocks(width: int, part):
    """The sum of ``part`` over the rows of a task, as one row of doubles or longs."""

    def task(batches):
        total = None
        for batch in batches:
            if batch.num_rows:
                own = part(_matrix(batch.column(0), width))
                total = own if total is None else total + own
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], ["block"])

    return task


def _added(kind):
    def task(batches):
        rows = [b for batch in batches for b in batch.column(0).to_pylist()]
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array([sum(np.frombuffer(r, kind) for r in rows).tobytes()], pa.binary())], ["block"])

    return task


class Passes:
    """Sums over the rows of a stored table of integer vectors."""

    def __init__(self, held: DataFrame, width: int):
        self.vectors, self.width = held.select("v"), width
        self.tasks = held.rdd.getNumPartitions()

    def total(self, part, shape: tuple[int, ...], kind=np.float64) -> np.ndarray:
        blocks = self.vectors.mapInArrow(_blocks(self.width, part), SUM)
        if self.tasks * math.prod(shape) * 8 > DRIVER_BYTES:
            blocks = blocks.repartition(math.isqrt(self.tasks) + 1).mapInArrow(_added(kind), SUM)
        rows = [np.frombuffer(r.block, kind) for r in blocks.collect()]
        return sum(rows).reshape(shape) if rows else np.zeros(shape, kind)

    def sums(self) -> tuple[int, list[int]]:
        """Rows, and exact sums of each dimension."""

        def part(x):
            return np.concatenate([[len(x)], (x >> 26).sum(0), (x & ((1 << 26) - 1)).sum(0)])

        out = self.total(part, (1 + 2 * self.width,), np.int64).tolist()
        return out[0], [(high << 26) + low for high, low in zip(out[1 : self.width + 1], out[self.width + 1 :], strict=True)]

    def centre(self, n: int, sums: list[int]) -> None:
        self.n, self.mean = n, np.array([s / n for s in sums])

    def applied(self, q: np.ndarray) -> np.ndarray:
        """Covariance times ``q``."""
        mean = self.mean

        def part(x):
            c = x - mean
            return c.T @ (c @ q)

        return self.total(part, q.shape) / self.n

    def variances(self) -> np.ndarray:
        mean = self.mean
        return self.total(lambda x: ((x - mean) ** 2).sum(0), (self.width,)) / self.n

    def covariance_of(self, basis: np.ndarray) -> np.ndarray:
        """Covariance of the rows after they are centred and multiplied by ``basis``."""
        mean, k = self.mean, basis.shape[1]

        def part(x):
            w = (x - mean) @ basis
            return np.concatenate([w.T @ w, w.sum(0)[None]])

        out = self.total(part, (k + 1, k)) / self.n
        return out[:k] - np.outer(out[k], out[k])


def lower_end(apply, width: int, steps: int, rng) -> float:
    """About the smallest eigenvalue, by Lanczos steps from a random vector, less the error that they leave."""
    basis, alpha, beta = [], [], []
    v = rng.standard_normal(width)
    v /= np.linalg.norm(v)
    for _ in range(min(steps, width)):
        basis.append(v)
        w = apply(v[:, None])[:, 0]
        alpha.append(float(v @ w))
        held = np.array(basis)
        for _ in range(2):
            w = w - held.T @ (held @ w)
        beta.append(float(np.linalg.norm(w)))
        if beta[-1] <= 1e-12 * max(1.0, abs(alpha[0])):
            break
        v = w / beta[-1]
    values, vectors = np.linalg.eigh(np.diag(alpha) + np.diag(beta[:-1], 1) + np.diag(beta[:-1], -1))
    return max(0.0, float(values[0] - beta[-1] * abs(vectors[-1, 0])))


def growth(x: float) -> float:
    """By how much a Chebyshev polynomial grows at x with each degree, outside of [-1, 1]."""
    x = max(abs(x), 1.0)
    return x + math.sqrt(x * x - 1)


def leading(apply, width: int, wanted: int, guard: int = GUARD, seed: int = 0, rounds: int = 1000) -> tuple[np.ndarray, np.ndarray]:
    """The ``wanted`` largest eigenvalues, falling, and unit eigenvectors of a symmetric matrix known by ``apply(block)``.

    It must have no negative eigenvalue. Each round ends in residuals; the last one's are at the level of rounding.
    """
    rng = np.random.default_rng(seed)
    size = min(width, wanted + guard)

    def ritz(q):
        q = np.linalg.qr(q)[0]
        vq = apply(q)
        values, turn = np.linalg.eigh((q.T @ vq + vq.T @ q) / 2)
        values, turn = values[::-1], turn[:, ::-1]
        return values, q @ turn, vq @ turn

    values, q, vq = ritz(rng.standard_normal((width, size)))
    low, before = None, math.inf
    for _ in range(rounds):
        top = max(float(values[0]), 0.0)
        error = float(np.linalg.norm(vq[:, :wanted] - q[:, :wanted] * values[:wanted], axis=0).max(initial=0.0))
        if error <= CERTAIN * top or error <= ROUNDED * top and error > before / 2 or size == width and before < math.inf:
            return values[:wanted], q[:, :wanted]
        if size == width:
            before = error  # the block is the whole space: once more, for the rounding
            values, q, vq = ritz(q)
            continue
        if error > before / 4:
            # Too little below the block is damped: take more into it.
            size = min(width, size + guard)
            values, q, vq = ritz(np.concatenate([q, rng.standard_normal((width, size - q.shape[1]))], 1))
            before = math.inf
            continue
        before = error
        if low is None:
            low = lower_end(apply, width, STEPS, rng)
        low, high = min(low, float(values[-1])), float(values[-1])
        if high - low <= 1e-9 * top:
            low = max(0.0, high - 1e-3 * top)
            high = max(high, low + 1e-9 * top)
        middle, half = (high + low) / 2, (high - low) / 2
        apart = math.log10(growth((top - middle) / half) / growth((float(values[wanted - 1]) - middle) / half))
        degree = max(2, min(DEGREE, int(SPREAD / max(apart, 1e-9))))
        # T(j+1) = 2 x T(j) - T(j-1), each scaled by the value at the top, so that nothing overflows.
        first = half / (top - middle)
        scale = first
        old, new = q, (vq - middle * q) * (scale / half)
        for _ in range(degree - 1):
            then = 1 / (2 / first - scale)
            old, new = new, (apply(new) - middle * new) * (2 * then / half) - (scale * then) * old
            scale = then
        values, q, vq = ritz(new)
    raise ArithmeticError(f"no certified eigenvectors after {rounds} rounds")


def whiten(vectors: DataFrame, components: int = 32, scale: int = 64, guard: int = GUARD, vec_id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """The rows of ``vectors`` projected on the leading eigenvectors of their covariance, each with variance one.

    Entries c become x = floor(scale * c), c as double, clipped at 2**52 in magnitude; adding a constant to all entries would
    change nothing. The covariance has divisor n. Returns vec_id, component (from 1, by falling eigenvalue e), n (rows), deviation
    (sum over dimensions of (n * x - S)**2, S the sums; exact; null beyond 64 bits), whitened, explained (e as part of the trace)
    and identity_error (largest entry of the covariance of the whitened less the identity), a row for each row and component.

    Vectors that are null or hold null or a number that is not finite are left out. Shorter vectors count as filled with zeros.
    Repeated rows and rows without an id count like others. Directions without variance are no components, so one row, equal
    rows or an empty table give no rows. Other columns are not read.
    """
    spark = vectors.sparkSession
    ship(spark)
    v = F.col(f"`{vector}`").cast("array<double>")
    fine = v.isNotNull() & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    clip = F.lit(float(CLIP))
    whole = F.transform(v, lambda x: F.floor(F.greatest(-clip, F.least(clip, x * scale))).cast("long"))
    held = stored(vectors.filter(fine).select(F.col(f"`{vec_id}`").cast("long").alias("vec_id"), whole.alias("v")), "vectors")
    width, most = held.agg(F.max(F.size("v")), F.max(F.array_max(F.transform("v", F.abs)))).first()
    if not width:
        return spark.createDataFrame([], OUT)
    passes = Passes(held, width)
    n, sums = passes.sums()
    passes.centre(n, sums)
    trace = float(passes.variances().sum())
    wanted = min(components, width)
    values, basis = leading(passes.applied, width, wanted, guard) if trace > 0 else (np.zeros(0), np.zeros((width, 0)))
    real = values > FLAT * trace
    values, basis = values[real], basis[:, real]
    turned = basis / np.sqrt(values)
    k = len(values)
    error = float(np.abs(passes.covariance_of(turned) - np.eye(k)).max(initial=0.0)) if k else 0.0
    explained, mean = values / trace if k else values, passes.mean
    # Whether each square and their sum fit into 64 bits, whatever the row.
    narrow = width * (n * most + max(abs(s) for s in sums)) ** 2 < 2**63

    def deviations(x):
        if narrow:
            return pa.array(((n * x - np.array(sums, np.int64)) ** 2).sum(1))
        exact = [sum((n * a - s) ** 2 for a, s in zip(row, sums, strict=True)) for row in x.tolist()]
        return pa.array([e if e < 2**63 else None for e in exact], pa.int64())

    def task(batches):
        for batch in batches:
            x = _matrix(batch.column(1), width)
            rows = pa.array(np.repeat(np.arange(len(x)), k))
            w = ((x - mean) @ turned).reshape(-1)
            each = lambda values: pa.array(np.tile(values, len(x)))
            same = lambda value, kind: pa.array(np.full(len(rows), value, kind))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(rows), each(np.arange(1, k + 1, dtype=np.int32)), same(n, np.int64), deviations(x).take(rows), pa.array(w), each(explained), same(error, np.float64)],
                [c.split()[0] for c in OUT.split(", ")],
            )

    return held.mapInArrow(task, OUT) if k else spark.createDataFrame([], OUT)
