"""Next-fit packing of ordered rows into documents of bounded size."""

from __future__ import annotations

import sys
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cartolex.operators.running import with_running
from cartolex.session import durable
from cartolex.vocab.enums import MAX_DOCUMENT_BYTES

# Tasks carry the functions of this module with them: workers need no copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

SHARDS_PER_NODE = 64


def _next_opening(begin: np.ndarray, end: np.ndarray, room: int) -> np.ndarray:
    """Index of the row that opens the next shard when row i opens one."""
    return np.maximum(np.searchsorted(end, begin + room, side="right"), np.arange(len(begin)) + 1)


def _steps(room: int):
    """Per node: what follows when one of its first rows opens a shard.

    Only rows up to one full shard past the node's start can be its first
    opening, whatever was packed before.
    """

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("before")
        begin = rows["before"].to_numpy()
        end = begin + rows["_w"].to_numpy()
        follow, n = _next_opening(begin, end, room), len(begin)
        exit_, opened = begin.copy(), np.ones(n, dtype=np.int64)
        for i in range(n - 1, -1, -1):
            if follow[i] < n:
                exit_[i], opened[i] = exit_[follow[i]], opened[follow[i]] + 1
        first = slice(0, min(int(np.searchsorted(end, begin[0] + room, side="right")) + 1, n))
        return pd.DataFrame(
            {
                "_region": rows["_region"].iloc[0],
                "_node": rows["_node"].iloc[0],
                "at": begin[first],
                "reach": end[first],
                "exit": exit_[first],
                "opened": opened[first],
            }
        )

    return run


def _connect(room: int):
    """First opening in the next node for each way the node before can end."""

    def run(ways: pd.DataFrame, openings: pd.DataFrame) -> pd.DataFrame:
        reach = openings.sort_values("reach")
        found = np.searchsorted(reach["reach"].to_numpy(), ways["exit"].to_numpy() + room, side="right")
        starts = np.append(reach["at"].to_numpy().astype("float64"), np.nan)
        to = pd.Series(starts[found]).astype("Int64")
        return pd.DataFrame({"_region": ways["_region"], "at": ways["at"], "opened": ways["opened"], "to": to.to_numpy()})

    return run


def _number(room: int):
    """Shard number of every row of a node whose first opening is known."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("before")
        begin = rows["before"].to_numpy()
        follow = _next_opening(begin, begin + rows["_w"].to_numpy(), room)
        opens = np.zeros(len(begin), dtype=np.int64)
        at = rows["at"].iloc[0]
        if not pd.isna(at):
            i = int(np.searchsorted(begin, int(at)))
            while i < len(begin):
                opens[i] = 1
                i = int(follow[i])
        return pd.DataFrame(
            {"_region": rows["_region"], "before": begin, "shard": rows["shard_before"].iloc[0] + np.cumsum(opens)}
        )

    return run


def shard_by_bytes(
    index: DataFrame,
    region: Column,
    order: Sequence[str],
    size: Column,
    overhead: int = 0,
    max_bytes: int = MAX_DOCUMENT_BYTES,
    chunk: Column | None = None,
    shards_per_node: int = SHARDS_PER_NODE,
) -> DataFrame:
    """Add ``shard``: rows in order fill a document until the next would exceed ``max_bytes``.

    ``size`` is the row's JSON size, ``overhead`` that of the document without
    rows; members are separated by one byte. A shard is never empty, so an
    oversize row sits alone.

    Where a shard ends depends on where it began, so packing looks sequential.
    Rows are cut by running bytes into nodes of ``shards_per_node`` documents.
    Each node works out, for the few rows that may open its first shard, how it
    would end; those ways link up from node to node, and the way that starts
    with the region's first row is followed by doubling its stride. No task
    holds more than one node.
    """
    room = max_bytes - overhead + 1
    weighed = index.withColumns({"_region": region.cast("string"), "_w": size.cast("bigint") + 1})
    run = with_running(weighed, order, ["_region"], F.col("_w"), chunk).drop("position")
    run = durable(run.withColumn("_node", F.floor(F.col("before") / F.lit(room * shards_per_node)).cast("bigint")))
    slim = run.select("_region", "_node", "before", "_w")

    steps = durable(
        slim.groupBy("_region", "_node").applyInPandas(
            _steps(room), "_region string, _node long, at long, reach long, exit long, opened long"
        )
    )
    by_node = Window.partitionBy("_region").orderBy("_node")
    nodes = steps.select("_region", "_node").distinct().withColumns(
        {"_next": F.lead("_node").over(by_node), "_nth": F.row_number().over(by_node)}
    )
    nodes = durable(nodes)
    ways = steps.join(nodes, ["_region", "_node"])
    linked = ways.filter("_next IS NOT NULL").select("_region", F.col("_next").alias("_node"), "at", "exit", "opened")
    linked = linked.toDF(*linked.columns)
    openings = steps.select("_region", "_node", "at", "reach").toDF("_region", "_node", "at", "reach")
    jumps = durable(
        linked.groupBy("_region", "_node")
        .cogroup(openings.groupBy("_region", "_node"))
        .applyInPandas(_connect(room), "_region string, at long, opened long, to long")
        .filter("to IS NOT NULL")
    )
    path = nodes.filter("_nth = 1").select("_region", F.lit(0).cast("bigint").alias("at"), F.lit(0).cast("bigint").alias("shard"))
    longest = nodes.agg(F.max("_nth")).first()[0] or 1
    stride = 1
    while stride < longest:
        ahead = path.join(jumps, ["_region", "at"]).select(
            "_region", F.col("to").alias("at"), (F.col("shard") + F.col("opened")).alias("shard")
        )
        path = durable(path.unionByName(ahead))
        further = jumps.select("_region", F.col("at").alias("to"), F.col("to").alias("_to"), F.col("opened").alias("_more"))
        jumps = durable(
            jumps.join(further, ["_region", "to"]).select(
                "_region", "at", (F.col("opened") + F.col("_more")).alias("opened"), F.col("_to").alias("to")
            )
        )
        stride *= 2

    opened = path.join(ways.select("_region", "_node", "_next", "at", "opened"), ["_region", "at"])
    known = opened.select("_region", "_node", "at", (F.col("shard") - 1).alias("shard_before"))
    # The last node of a region may open no shard at all.
    quiet = (
        opened.filter("_next IS NOT NULL")
        .select(
            "_region",
            F.col("_next").alias("_node"),
            F.lit(None).cast("bigint").alias("at"),
            (F.col("shard") + F.col("opened") - 1).alias("shard_before"),
        )
        .join(known.select("_region", "_node"), ["_region", "_node"], "left_anti")
    )
    states = known.unionByName(quiet)
    shards = (
        slim.join(states, ["_region", "_node"])
        .groupBy("_region", "_node")
        .applyInPandas(_number(room), "_region string, before long, shard long")
    )
    return run.join(shards, ["_region", "before"]).drop("_region", "before", "_w", "_node")
