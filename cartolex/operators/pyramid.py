"""Greedy map clusters for every zoom, each level built from the one below it."""

from __future__ import annotations

import math
import sys

from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cartolex.operators.grid import CLUSTER_MAX_ZOOM, CLUSTER_RADIUS_PX, TILE_PX
from cartolex.session import durable

# Tasks carry the functions of this module with them: workers need no copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Units around the world (about a centimetre), and spots across a radius at the deepest zoom.
WORLD, SPOTS = 1 << 32, 16
#: Cells across a tile, and across the strip of its neighbours that a task sees besides.
TILE, HALO = 32, 8
OPEN, CENTRE, MEMBER = 0, 1, 2


def radius_at(zoom: int, radius_px: int = CLUSTER_RADIUS_PX, tile_px: int = TILE_PX) -> int:
    return radius_px * WORLD // (tile_px << zoom)


def map_units(lng: Column, lat: Column) -> tuple[Column, Column]:
    """Web-Mercator position in whole units; what lies beyond the map is moved to its edge."""
    bounded = F.radians(F.greatest(F.lit(-85.05112878), F.least(F.lit(85.05112878), lat)))
    x = (lng + 180.0) / 360.0
    y = (1 - F.log(F.tan(bounded) + 1 / F.cos(bounded)) / math.pi) / 2
    known = lng.isNotNull() & lat.isNotNull() & ~F.isnan(lng) & ~F.isnan(lat)
    return tuple(F.when(known, F.greatest(F.lit(0), F.least(F.lit(WORLD - 1), F.floor(a * float(WORLD)))).cast("bigint")) for a in (x, y))


def _merged(rows: DataFrame, *keys: str | Column) -> DataFrame:
    """Total and mean position (rounded down) of the rows of each key; sums are exact, whatever their order."""
    weighted = {a: F.sum(F.col(a).cast("decimal(12,0)") * F.col("points").cast("decimal(18,0)")) for a in ("x", "y")}
    totals = rows.groupBy(*keys).agg(F.min("id").alias("id"), F.sum("points").alias("points"), weighted["x"].alias("x"), weighted["y"].alias("y"))
    return totals.withColumns({a: F.expr(f"{a} div points") for a in ("x", "y")})


def map_spots(points: DataFrame, id: str, lng: Column, lat: Column, side: int) -> DataFrame:
    """(id, points, x, y): the points of each square of ``side`` units as one, under their least id.

    However many points a place has, the squares around it are bounded by its area. Rows without a position are left out.
    """
    x, y = map_units(lng.cast("double"), lat.cast("double"))
    rows = points.select(F.col(id).alias("id"), F.lit(1).cast("bigint").alias("points"), x.alias("x"), y.alias("y")).filter("x IS NOT NULL AND y IS NOT NULL AND id IS NOT NULL")
    return _merged(rows, F.floor(F.col("x") / side), F.floor(F.col("y") / side)).select("id", "points", "x", "y")


def _settle(radius: int, shift: int, tile: int, halo: int):
    """Decide what one tile can decide: its own rows come out, those of its halo only help."""
    side, wide = math.isqrt(radius * radius // 2), tile + 2 * halo + 4

    def run(key, rows):
        import numpy as np

        rows = rows.sort_values(["_order", "id"], ignore_index=True)
        x, y, state = (rows[c].to_numpy(np.int64).copy() for c in ("x", "y", "state"))
        none = len(rows)
        # Cells are numbered with two empty ones at each edge, so that steps to neighbours never leave the array.
        cx, cy = (a // side + shift - t * tile + halo + 2 for a, t in ((x, key[0]), (y, key[1])))
        cell = cx * wide + cy
        steps = [i * wide + j for i in range(-2, 3) for j in range(-2, 3)]
        # Two rows of a cell are within the radius, so a cell has one centre at most.
        centre = np.full(wide * wide, none)
        centre[cell[state == CENTRE]] = np.flatnonzero(state == CENTRE)
        seen = np.zeros((wide, wide), bool)
        seen[4:-4, 4:-4] = True

        def nearby(some):
            """First centre within the radius of each of the rows."""
            first = np.full(len(some), none)
            for step in steps:
                c = centre[cell[some] + step]
                held = np.flatnonzero(c < none)
                c, r = c[held], some[held]
                held = held[(x[c] - x[r]) ** 2 + (y[c] - y[r]) ** 2 <= radius * radius]
                first[held] = np.minimum(first[held], centre[cell[some[held]] + step])
            return first

        def least(values):
            """Least value of the 24 cells around each."""
            grid, out = values.reshape(wide, wide), np.full((wide, wide), none)
            for i in range(5):
                for j in range(5):
                    if (i, j) != (2, 2):
                        out[2:-2, 2:-2] = np.minimum(out[2:-2, 2:-2], grid[i : wide - 4 + i, j : wide - 4 + j])
            return out

        while True:
            undecided = np.flatnonzero(state == OPEN)
            state[undecided[nearby(undecided) < none]] = MEMBER
            undecided = np.flatnonzero(state == OPEN)
            first = np.full(wide * wide, none)
            first[cell[undecided][::-1]] = undecided[::-1]
            won = np.flatnonzero((first < least(first).ravel()) & seen.ravel() & (first < none))
            if not len(won):
                break
            state[first[won]] = CENTRE
            centre[won] = first[won]
        # A row has its centre for good once nothing near it is open.
        settled = ((np.minimum(least(first), first.reshape(wide, wide)) == none) & seen).ravel()[cell]
        owner = nearby(np.arange(none))
        owner[state == CENTRE] = np.flatnonzero(state == CENTRE)
        ids = rows["id"].to_numpy(object)
        rows["owner"] = [ids[o] if done else None for o, done in zip(owner, settled, strict=True)]
        rows["state"] = state
        own = (cx >= halo + 2) & (cx < halo + 2 + tile) & (cy >= halo + 2) & (cy < halo + 2 + tile)
        return rows.loc[own, ["id", "points", "x", "y", "_order", "state", "owner"]]

    return run


def greedy_clusters(items: DataFrame, radius: int, tile: int = TILE, halo: int = HALO) -> DataFrame:
    """``items`` (id, points, x, y) with ``owner``, the id of the centre that each belongs to.

    As if rows were taken in order of a hash of their id: a row that no centre has within ``radius`` units becomes one,
    the others belong to the first centre that is so near. A task decides a tile with what it sees of the neighbours; rows
    whose answer hangs on more than that go again, with what is known by then, on tiles moved by half their width. The
    first open row of all is always decided, so this ends; the hash keeps chains of rows that wait for each other short.
    Ids must be unique.
    """
    if radius < 2 or halo < 2:
        raise ValueError("a radius of at least 2 units and a halo of at least 2 cells are needed")
    side, shift = math.isqrt(radius * radius // 2), 0
    kind = items.schema["id"].dataType.simpleString()
    rows = items.select("id", "points", "x", "y", F.xxhash64("id").alias("_order"), F.lit(OPEN).alias("state"), F.lit(None).cast(kind).alias("owner"))
    schema = f"id {kind}, points bigint, x bigint, y bigint, _order bigint, state int, owner {kind}"
    while True:
        seen_by = {
            t: F.explode(F.sequence(*[F.floor((F.floor(F.col(a) / side) + shift + d) / tile) for d in (-halo, halo)]))
            for t, a in (("_tx", "x"), ("_ty", "y"))
        }
        copies = rows.drop("owner").withColumn("_tx", seen_by["_tx"]).withColumn("_ty", seen_by["_ty"])
        rows = durable(copies.groupBy("_tx", "_ty").applyInPandas(_settle(radius, shift, tile, halo), schema))
        if rows.filter("owner IS NULL").isEmpty():
            return rows.select("id", "points", "x", "y", "owner")
        shift = (shift + tile // 2) % tile


def cluster_pyramid(
    points: DataFrame, id: str, lng: Column, lat: Column, max_zoom: int = CLUSTER_MAX_ZOOM, radius_px: int = CLUSTER_RADIUS_PX
) -> DataFrame:
    """(zoom, cluster_id, points, lng, lat, parent_id) for every zoom from ``max_zoom`` to 0.

    The deepest level clusters the spots of the points (squares of a sixteenth of the radius), each other one the clusters
    of the level below, at the mean position of their points. ``parent_id`` is the cluster of the next smaller zoom.
    """
    deepest = radius_at(max_zoom, radius_px)
    items, levels = map_spots(points, id, lng, lat, max(1, deepest // SPOTS)), []
    for zoom in range(max_zoom, -1, -1):
        owned = greedy_clusters(items, radius_at(zoom, radius_px))
        if zoom < max_zoom:
            levels.append(owned.withColumn("zoom", F.lit(zoom + 1)))
        merged = owned.select(F.col("owner").alias("_centre"), "id", "points", "x", "y")
        items = _merged(merged, "_centre").select(F.col("_centre").alias("id"), "points", "x", "y")
    levels.append(items.withColumns({"owner": F.lit(None).cast(items.schema["id"].dataType), "zoom": F.lit(0)}))
    out = levels[0]
    for level in levels[1:]:
        out = out.unionByName(level)
    lng_out = (F.col("x") + 0.5) / float(WORLD) * 360.0 - 180.0
    lat_out = F.degrees(F.atan(F.sinh(math.pi * (1 - 2 * (F.col("y") + 0.5) / float(WORLD)))))
    return out.select("zoom", F.col("id").alias("cluster_id"), "points", lng_out.alias("lng"), lat_out.alias("lat"), F.col("owner").alias("parent_id"))
