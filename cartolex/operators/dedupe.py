"""Radius de-duplication of places that share a key."""

from __future__ import annotations

import sys
from collections.abc import Sequence

from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cartolex.functions.geo import chord_km, cube_cell, haversine_km
from cartolex.session import durable

# Tasks carry the functions of this module with them: workers need no copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

CELL = ["_x", "_y", "_z"]
#: Rounds before the spots left of a key are folded in order by one task, and how many spots that may be.
ROUNDS, FOLD = 2, 50_000
# The cell and its 26 neighbours.
_REACH = """inline(flatten(transform(sequence(_x - 1, _x + 1), x -> flatten(transform(sequence(_y - 1, _y + 1),
    y -> transform(sequence(_z - 1, _z + 1), z -> named_struct('_x', x, '_y', y, '_z', z)))))))"""


def _with_cell(df: DataFrame, radius_m: float) -> DataFrame:
    side = max(chord_km(radius_m / 1000.0), 1e-6) * (1 + 1e-9)
    x, y, z = cube_cell(F.col("_lng"), F.col("_lat"), side)
    return df.withColumns({"_x": x, "_y": y, "_z": z})


def _around(anchors: DataFrame) -> DataFrame:
    """Each anchor once per cell it can reach."""
    return anchors.select(
        "_key",
        F.col("_rank").alias("_a_rank"),
        F.col("_lng").alias("_a_lng"),
        F.col("_lat").alias("_a_lat"),
        F.expr(_REACH),
    )


def _within(points: DataFrame, anchors: DataFrame, radius_m: float) -> DataFrame:
    """Points joined to the anchors of the same key within the radius."""
    km = haversine_km(F.col("_lng"), F.col("_lat"), F.col("_a_lng"), F.col("_a_lat"))
    return points.join(_around(anchors), ["_key", *CELL]).where(km * 1000.0 <= radius_m)


def _points(df: DataFrame, id: str, key: Column, lng: Column, lat: Column, priority: Sequence[Column]) -> DataFrame:
    rank = F.struct(*[p.alias(f"p{i}") for i, p in enumerate(priority)], F.col(id).alias("id"))
    return df.select(
        key.alias("_key"), lng.cast("double").alias("_lng"), lat.cast("double").alias("_lat"), rank.alias("_rank")
    )


def _fold(radius_m: float):
    """The spots of one key in order: each stays unless one that stayed is near."""

    def run(rows):
        import math

        rows = rows.sort_values("_order")
        held: dict = {}
        won = []
        for lng, lat, x, y, z in zip(*(rows[c].tolist() for c in ("_lng", "_lat", "_x", "_y", "_z")), strict=True):
            here, near = math.radians(lat), False
            for cell in [(i, j, k) for i in (x - 1, x, x + 1) for j in (y - 1, y, y + 1) for k in (z - 1, z, z + 1)]:
                for a, b, there in held.get(cell, ()):
                    h = math.sin(math.radians(b - lat) / 2) ** 2 + math.cos(here) * math.cos(there) * math.sin(math.radians(a - lng) / 2) ** 2
                    near = near or 2 * 6371.0 * math.asin(math.sqrt(min(h, 1.0))) * 1000.0 <= radius_m
            if not near:
                held.setdefault((x, y, z), []).append((lng, lat, here))
            won.append(not near)
        return rows[["_id"]].assign(_won=won)

    return run


def spatial_dedupe(
    df: DataFrame,
    id: str,
    key: Column,
    lng: Column,
    lat: Column,
    priority: Sequence[Column],
    radius_m: float,
) -> DataFrame:
    """Add ``kept``: the greedy choice in priority order.

    Rows are taken best first (``priority`` ascending, then ``id``); a row is
    dropped when a row already kept has the same key within the radius. A row
    near a dropped row only stays.

    The greedy result is reached in rounds without listing pairs. Rows at one
    spot count once. Each grid cell offers its best open row; an offer is kept
    when no better open row lies within the radius, and closes every open row
    around it. The best open row overall always passes, so rounds end. A row is
    only ever compared with one offer per reachable cell.

    Priorities that rise along a row of neighbours would take a round for each
    spot. So after ``ROUNDS`` the open spots of a key, if they are at most
    ``FOLD``, are folded in order by one task; only a key with more goes on.
    """
    points = _points(df, id, key, lng, lat, priority)
    spots = points.groupBy("_key", "_lng", "_lat").agg(F.min("_rank").alias("_rank"))
    still_open = durable(_with_cell(spots, radius_m))
    kept_rounds = []
    while not still_open.isEmpty():
        offers = (
            still_open.groupBy("_key", *CELL)
            .agg(F.min_by(F.struct("_rank", "_lng", "_lat"), "_rank").alias("_best"))
            .select("_key", *CELL, "_best.*")
        )
        beaten = (
            _within(still_open, offers, radius_m)
            .where(F.col("_rank") < F.col("_a_rank"))
            .select(F.col("_a_rank.id").alias("_id"))
            .distinct()
        )
        unbeaten = offers.join(beaten, F.col("_rank.id") == F.col("_id"), "left_anti")
        # ``_won`` is true for a winner, false for a row near one, NULL while undecided.
        decided = (
            _within(still_open, unbeaten, radius_m)
            .groupBy(F.col("_rank.id").alias("_id"))
            .agg(F.bool_or(F.col("_rank.id") == F.col("_a_rank.id")).alias("_won"))
        )
        state = durable(still_open.join(decided, F.col("_rank.id") == F.col("_id"), "left").drop("_id"))
        kept_rounds.append(state.filter("_won").select(F.col("_rank.id").alias("_id")))
        still_open = state.filter("_won IS NULL").drop("_won")
        if len(kept_rounds) == ROUNDS:
            few = still_open.groupBy("_key").agg(F.count("*").alias("_n")).filter(F.col("_n") <= FOLD).select("_key")
            placed = still_open.join(few, "_key", "left_semi").withColumn(
                "_order", F.row_number().over(Window.partitionBy("_key").orderBy("_rank"))
            )
            rows = placed.select("_key", F.col("_rank.id").alias("_id"), "_lng", "_lat", *CELL, "_order")
            kind = rows.schema["_id"].dataType.simpleString()
            folded = durable(rows.groupBy("_key").applyInPandas(_fold(radius_m), f"_id {kind}, _won boolean"))
            kept_rounds.append(folded.filter("_won").select("_id"))
            still_open = durable(still_open.join(few, "_key", "left_anti"))
    winners = None
    for part in kept_rounds:
        ids = part.select(F.col("_id").alias(id), F.lit(True).alias("kept"))
        winners = ids if winners is None else winners.unionByName(ids)
    if winners is None:
        return df.withColumn("kept", F.lit(False))
    return df.join(winners, id, "left").withColumn("kept", F.coalesce(F.col("kept"), F.lit(False)))


def nearest_anchor(
    points: DataFrame,
    anchors: DataFrame,
    id: str,
    key: Column,
    lng: Column,
    lat: Column,
    priority: Sequence[Column],
    radius_m: float,
    as_name: str = "anchor_id",
) -> DataFrame:
    """Best-priority anchor of the same key within the radius of each point.

    Anchors come from ``spatial_dedupe``, hence lie further apart than the
    radius and only a few fit around one point. Points without one are left out.
    """
    left = _with_cell(_points(points, id, key, lng, lat, priority), radius_m)
    right = _with_cell(_points(anchors, id, key, lng, lat, priority), radius_m)
    return (
        _within(left, right, radius_m)
        .groupBy(F.col("_rank.id").alias(id))
        .agg(F.min("_a_rank").alias("_a"))
        .select(id, F.col("_a.id").alias(as_name))
    )
