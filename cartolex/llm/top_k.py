"""Exact top-k search by inner product with ball trees.

Candidates go to the nearest of some cells, which are the leaves of a ball tree over a sample, and cells of many rows are dealt
out to several shards by hash. A task builds a ball tree over its shard: halves along the direction of the widest spread, each
node with its centre and radius, so that no vector below a node has an inner product with a query of more than
query * centre + |query| * radius. Each query goes down from the root on its own, always into the open node with the largest
bound, and ends at the first that its k-th score shuts out, so subtrees are left unseen. A query first searches one shard of
the cell that promises most. It takes the k-th score found there to the others: cells that cannot reach it are not sent the
query at all. Cells hold all rows and their radii are measured over all; the sample only decides where they lie. Scores are
sums of products of whole numbers and thus exact.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cartolex.llm.common import ship, stored

#: Candidates of a shard, about, and of a leaf at most.
SHARD, LEAF = 16_384, 256
#: Cells at most, and vectors of the sample that places them.
CELLS, SAMPLE = 1024, 4096
#: Queries searched together.
BATCH = 512
NONE = -(2**62)
#: Products up to here are exact in floating point.
EXACT = 2**52
FOUND = "query_id long, vec_id long, score long"


def _halves(own: np.ndarray) -> np.ndarray:
    """Order of vectors along the direction of their widest spread."""
    far = own[((own - own.mean(0)) ** 2).sum(1).argmax()]
    other = own[((own - far) ** 2).sum(1).argmax()]
    return np.argsort(own @ (other - far), kind="stable")


def _bounds(queries: np.ndarray, centres: np.ndarray, radii: np.ndarray) -> np.ndarray:
    """For rows of queries and balls that belong together, what no inner product exceeds, with room for rounding."""
    sizes = np.sqrt((queries**2).sum(-1))
    out = (queries * centres).sum(-1) + sizes * radii
    return out + 1 + 1e-9 * (np.abs(out) + sizes * (1 + radii + np.sqrt((centres**2).sum(-1))))


class Tree:
    """Ball tree over the rows of a matrix; ``below`` has the first of a node's two children, or -1 at leaves."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray):
        order, centres, radii, below, spans = np.arange(len(ids)), [], [], [], [(0, len(ids))]
        for a, b in spans:
            own = vectors[order[a:b]].astype(np.float64)
            centres.append(own.mean(0))
            radii.append(np.sqrt(((own - centres[-1]) ** 2).sum(1).max()))
            below.append(-1 if b - a <= LEAF else len(spans))
            if b - a > LEAF:
                order[a:b] = order[a:b][_halves(own)]
                spans += [(a, (a + b) // 2), ((a + b) // 2, b)]
        self.ids, self.vectors, self.spans = ids[order], vectors[order], spans
        self.centres, self.radii, self.below = np.array(centres), np.array(radii), np.array(below)
        self.visited = 0

    def search(self, ids: np.ndarray, queries: np.ndarray, least: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Scores and ids of the k best for each query that reach its bound ``least``; the query's own id takes no part."""
        n = len(ids)
        scores, found = np.full((n, k), NONE, np.int64), np.full((n, k), 2**62, np.int64)
        kth, plain = least.copy(), queries.astype(np.float64)

        def visit(rows: np.ndarray, leaf: int) -> None:
            a, b = self.spans[leaf]
            self.visited += len(rows)
            own = (queries[rows] @ self.vectors[a:b].T).astype(np.int64)
            own[ids[rows][:, None] == self.ids[None, a:b]] = NONE
            hit = (own >= kth[rows][:, None]) & (own > NONE)
            some = np.flatnonzero(hit.any(1))
            if not len(some):
                return
            rows = rows[some]
            all_scores = np.concatenate([scores[rows], np.where(hit[some], own[some], NONE)], 1)
            all_ids = np.concatenate([found[rows], np.broadcast_to(self.ids[a:b], (len(rows), b - a))], 1)
            all_ids = np.where(all_scores == NONE, 2**62, all_ids)
            best = np.lexsort((all_ids, -all_scores))[:, :k]
            scores[rows], found[rows] = np.take_along_axis(all_scores, best, 1), np.take_along_axis(all_ids, best, 1)
            kth[rows] = np.maximum(kth[rows], scores[rows, k - 1])

        # Bounds of the nodes that a query has open; a node is opened only by its parent.
        open_ = np.full((n, len(self.spans)), -np.inf)
        open_[:, 0] = _bounds(plain, self.centres[0], self.radii[0])
        rows = np.arange(n)
        while len(rows):
            top = open_[rows].argmax(1)
            bound = open_[rows, top]
            # The best open node cannot reach the k-th score: nothing below any open node can.
            alive = (bound >= kth[rows]) & (bound > -np.inf)
            rows, top = rows[alive], top[alive]
            bound = bound[alive]
            open_[rows, top] = -np.inf
            first = self.below[top]
            inner = first >= 0
            for child in (0, 1):
                nodes = first[inner] + child
                own = _bounds(plain[rows[inner]], self.centres[nodes], self.radii[nodes])
                open_[rows[inner], nodes] = np.minimum(own, bound[inner])
            leaves = top[~inner]
            order = np.argsort(leaves, kind="stable")
            cuts = np.flatnonzero(np.diff(leaves[order], prepend=-1))
            for group in np.split(order, cuts[1:]) if len(order) else []:
                visit(rows[~inner][group], leaves[group[0]])
        return scores, found


def _cells(sample: np.ndarray, n: int) -> np.ndarray:
    """Centres of ``n`` parts of a sample, or fewer where it has fewer vectors, the largest part halved again and again."""
    parts, done = [sample], []
    while parts and len(parts) + len(done) < n:
        parts.sort(key=len)
        part = parts.pop()
        if (part == part[0]).all():
            done.append(part)
            continue
        order = _halves(part)
        parts += [part[order[: len(order) // 2]], part[order[len(order) // 2 :]]]
    return np.array([part.mean(0) for part in parts + done])


def _place(width: int, centres: np.ndarray):
    """Rows with their nearest cell, the distance to its centre and a number that tells repeated rows apart."""

    def task(batches):
        sizes, seen = (centres**2).sum(1), 0
        for batch in batches:
            for at in range(0, batch.num_rows, 4 * BATCH):
                part = batch.slice(at, 4 * BATCH)
                own = _matrix(part.column(1), width).astype(np.float64)
                cell = (sizes[None, :] - 2 * own @ centres.T).argmin(1)
                far = np.sqrt(((own - centres[cell]) ** 2).sum(1))
                number = np.arange(seen, seen + part.num_rows)
                seen += part.num_rows
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(cell.astype(np.int32)), pa.array(far), pa.array(number)], ["id", "v", "cell", "far", "number"])

    return task


def _routes(width: int, centres: np.ndarray, radii: np.ndarray, firsts: np.ndarray, splits: np.ndarray, home: bool):
    """Queries (id, v, least) as rows for a shard of their best cell (``home``), or for all others that may reach ``least``."""

    def task(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                part = batch.slice(at, 64)
                ids, least = part.column(0).to_numpy(zero_copy_only=False), part.column(2).to_numpy(zero_copy_only=False)
                own = _matrix(part.column(1), width).astype(np.float64)
                best = (own @ centres.T).argmax(1)
                first = firsts[best] + ids % splits[best]
                if home:
                    who, where = np.arange(len(ids)), first
                else:
                    bounds = np.stack([_bounds(q[None, :], centres, radii) for q in own])
                    who, cell = np.nonzero(bounds >= least[:, None])
                    many = splits[cell]
                    step = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
                    who, where = np.repeat(who, many), np.repeat(firsts[cell], many) + step
                    other = where != first[who]
                    who, where = who[other], where[other]
                for a in range(0, len(who), 4 * BATCH):
                    some = who[a : a + 4 * BATCH]
                    rows = part.take(pa.array(some))
                    yield pa.RecordBatch.from_arrays([pa.array(where[a : a + 4 * BATCH].astype(np.int32)), *rows.columns], ["shard", "id", "v", "least"])

    return task


def _matrix(column, width: int) -> np.ndarray:
    """Lists as rows of a matrix, shorter ones filled with zeros."""
    sizes = column.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    values = column.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    out = np.zeros((len(sizes), width), np.int64)
    rows = np.repeat(np.arange(len(sizes)), sizes)
    out[rows, np.arange(len(values)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = values
    return out


def _task(width: int, exact: bool, k: int):
    """Rows in order of shard, candidates before queries, to the best of the shard for each query."""

    def task(batches):
        shard, held, tree, asked = None, [], None, []

        def cast(m):
            return m.astype(np.float64) if exact else m

        def answer():
            nonlocal asked
            if asked and tree is not None:
                ids, vectors, least = (np.concatenate(x) for x in zip(*asked, strict=True))
                for a in range(0, len(ids), BATCH):
                    scores, found = tree.search(ids[a : a + BATCH], cast(vectors[a : a + BATCH]), least[a : a + BATCH], k)
                    real = scores > NONE
                    yield pa.RecordBatch.from_arrays([pa.array(np.repeat(ids[a : a + BATCH], real.sum(1))), pa.array(found[real]), pa.array(scores[real])], ["query_id", "vec_id", "score"])
            asked = []

        for batch in batches:
            shards, kinds = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
            ids, least = batch.column(2).to_numpy(zero_copy_only=False), batch.column(4).to_numpy(zero_copy_only=False)
            vectors = _matrix(batch.column(3), width)
            cuts = np.flatnonzero(np.concatenate([[True], (shards[1:] != shards[:-1]) | (kinds[1:] != kinds[:-1])])).tolist() + [len(ids)] if len(ids) else [0]
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                if shards[a] != shard:
                    yield from answer()
                    shard, held, tree = shards[a], [], None
                if kinds[a] == 0:
                    held.append((ids[a:b], vectors[a:b]))
                    continue
                if tree is None and held:
                    own_ids, own = (np.concatenate(x) for x in zip(*held, strict=True))
                    tree, held = Tree(own_ids, cast(own)), []
                asked.append((ids[a:b], vectors[a:b], least[a:b]))
                if sum(len(x[0]) for x in asked) >= BATCH:
                    yield from answer()
        yield from answer()

    return task


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 20, scale: int = 64, shard_rows: int = SHARD, vec_id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """The ``k`` rows of ``vectors`` with the largest inner product with each row of ``queries`` (both with the two columns).

    Components are floor(scale * x), x as double. Returns query_id, rank (from 1), vec_id and score; ties go to the smaller
    vec_id; a row with the query's id takes no part; all are returned if they are fewer than k. Rows without an id, and
    vectors that are null or hold a null or a number that is not finite, are left out. Shorter vectors count as filled with
    zeros. Rows that share an id are all candidates; as a query an id is asked once, with the least of its vectors. Scores
    beyond 64 bits wrap.
    """
    spark = vectors.sparkSession
    ship(spark)

    def whole(df: DataFrame) -> DataFrame:
        v = F.col(f"`{vector}`").cast("array<double>")
        fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
        rows = df.filter(F.col(f"`{vec_id}`").isNotNull() & v.isNotNull() & fine)
        limit = F.lit(float(2**62))
        return rows.select(F.col(f"`{vec_id}`").cast("long").alias("id"), F.transform(v, lambda x: F.floor(F.greatest(-limit, F.least(limit, x * scale))).cast("long")).alias("v"))

    held = stored(whole(vectors), "vectors")
    asked = stored(whole(queries).groupBy("id").agg(F.min("v").alias("v")), "queries")
    n, width, most = held.agg(F.count("*"), F.max(F.size("v")), F.max(F.aggregate("v", F.lit(0.0), lambda a, x: F.greatest(a, F.abs(x.cast("double")))))).first()
    ask_width, ask_most = asked.agg(F.max(F.size("v")), F.max(F.aggregate("v", F.lit(0.0), lambda a, x: F.greatest(a, F.abs(x.cast("double")))))).first()
    width = max(width or 0, ask_width or 0, 1)
    exact = (most or 0) * (ask_most or 0) * width < EXACT
    # The sample is bounded by SAMPLE vectors, what is known of the cells by CELLS rows.
    sample = held.select("v").orderBy(F.xxhash64("id", "v")).limit(SAMPLE).toArrow().column("v").combine_chunks()
    centres = _cells(_matrix(sample, width).astype(np.float64), min(CELLS, -(-n // shard_rows))) if n else np.zeros((1, width))
    placed = stored(held.mapInArrow(_place(width, centres), "id long, v array<long>, cell int, far double, number long"), "placed")
    radii, splits = np.zeros(len(centres)), np.ones(len(centres), np.int64)
    for cell, rows, far in placed.groupBy("cell").agg(F.count("*"), F.max("far")).collect():
        radii[cell], splits[cell] = far * (1 + 1e-9) + 1e-6, -(-rows // shard_rows)
    firsts = np.cumsum(splits) - splits
    shards = int(splits.sum())
    cells = spark.createDataFrame([(i, int(f), int(m)) for i, (f, m) in enumerate(zip(firsts, splits, strict=True))], "cell int, first int, splits int")
    shard = (F.col("first") + F.pmod(F.xxhash64("id", "v", "number"), F.col("splits"))).cast("int")
    candidates = placed.join(F.broadcast(cells), "cell").select(shard.alias("shard"), F.lit(0).alias("kind"), "id", "v", F.lit(NONE).alias("least"))
    parts = min(shards, 4 * int(spark.conf.get("spark.sql.shuffle.partitions")))

    def searched(rows: DataFrame, home: bool) -> DataFrame:
        routed = rows.select("id", "v", "least").mapInArrow(_routes(width, centres, radii, firsts, splits, home), "shard int, id long, v array<long>, least long")
        dealt = candidates.unionByName(routed.withColumn("kind", F.lit(1))).select("shard", "kind", "id", "v", "least")
        dealt = dealt.repartitionById(parts, F.col("shard")).sortWithinPartitions("shard", "kind")
        return stored(dealt.mapInArrow(_task(width, exact, k), FOUND), "found")

    found = searched(asked.withColumn("least", F.lit(NONE)), True)
    if shards > 1:
        kth = found.groupBy("query_id").agg(F.count("*").alias("n"), F.min("score").alias("least")).filter(F.col("n") >= k)
        known = asked.join(kth.select(F.col("query_id").alias("id"), "least"), "id", "left").withColumn("least", F.coalesce("least", F.lit(NONE)))
        # The queries are a stated set: each goes to the shards that may hold a better score, as a row that is searched there.
        found = found.unionByName(searched(known, False))
    order = W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return ranked.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
