"""Snapshot comparison: change detection, grace periods and soft delete."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cartolex.functions.hashing import json_list
from cartolex.functions.numbers import days_between
from cartolex.functions.text import short_hash
from cartolex.vocab.enums import DELETE_AFTER_RUNS, FRESHNESS_DAYS, ITEM_MISS_LIMIT


def _yes(c: Column) -> Column:
    return F.coalesce(c, F.lit(False))


def meta_hash(crawl_status: Column) -> Column:
    """Hash of the place fields shown on a document but absent from its pages."""
    text = lambda c: F.coalesce(F.col(c), F.lit(""))
    return short_hash(
        json_list(
            F.col("name"),
            F.col("kind"),
            F.col("address"),
            F.format_string("%.5f", F.col("lat")),
            F.format_string("%.5f", F.col("lng")),
            text("website"),
            text("phone"),
            text("instagram"),
            crawl_status,
        )
    )


def changed_pages(crawls: DataFrame, state: DataFrame, id: str) -> DataFrame:
    """Crawls (id, status, pages_hash) that succeeded and differ from the stored fingerprint.

    An empty stored fingerprint means the last extraction was incomplete, so
    the entity counts as changed.
    """
    before = state.select(id, F.col("pages_hash").alias("_before"))
    same = _yes((F.col("_before") != "") & (F.col("_before") == F.col("pages_hash")))
    return crawls.join(before, id, "left").filter((F.col("status") == "ok") & ~same).drop("_before")


def classify_changes(
    current: DataFrame,
    previous: DataFrame,
    id: str,
    complete: bool = True,
    delete_after: int = DELETE_AFTER_RUNS,
) -> DataFrame:
    """One row per entity with its ``action`` and the state that follows.

    ``current``: id, fresh, content_hash, meta_hash. ``previous``: id,
    content_hash, meta_hash, hidden_runs, in_index, has_document.
    ``content_hash`` of ``current`` is that of the document a write would
    produce; rows that are not fresh rebuild it from their old items.
    ``rebuilt`` marks those that need it. An incomplete run leaves vanished
    entities alone.
    """
    now = current.select(
        id,
        F.lit(True).alias("_now"),
        F.col("fresh").alias("_fresh"),
        F.col("content_hash").alias("_hash"),
        F.col("meta_hash").alias("_meta"),
    )
    old = previous.select(
        id,
        F.lit(True).alias("_old"),
        F.col("content_hash").alias("_old_hash"),
        F.col("meta_hash").alias("_old_meta"),
        F.coalesce("hidden_runs", F.lit(0)).alias("_hidden"),
        F.coalesce("in_index", F.lit(True)).alias("_in_index"),
        F.coalesce("has_document", F.lit(True)).alias("_has_document"),
    )
    both = now.join(old, id, "full").withColumns({c: _yes(F.col(c)) for c in ("_now", "_old", "_fresh")})
    same = _yes(F.col("_hash") == F.col("_old_hash"))
    returning = F.col("_hidden") > 0
    stale = returning | ~_yes(F.col("_meta") == F.col("_old_meta")) | ~F.col("_in_index")
    runs = F.col("_hidden") + 1
    written = F.when(same & ~returning, F.lit("unchanged")).otherwise(F.lit("updated"))
    gone = (
        F.when(F.lit(not complete), F.lit("kept"))
        .when(runs >= delete_after, F.lit("deleted"))
        .when(runs == 1, F.lit("hidden"))
        .otherwise(F.lit("still-hidden"))
    )
    action = (
        F.when(~F.col("_now"), gone)
        .when(~F.col("_old"), F.lit("created"))
        .when(F.col("_fresh"), written)
        .when(~stale, F.lit("carried"))
        .when(~F.col("_has_document"), F.lit("created"))
        .otherwise(written)
    )
    return both.select(
        id,
        action.alias("action"),
        (F.col("_now") & F.col("_old") & ~F.col("_fresh") & _yes(stale)).alias("rebuilt"),
        F.when(F.col("_now"), F.lit(0)).when(F.lit(complete), runs).otherwise(F.col("_hidden")).alias("hidden_runs"),
    )


def snapshot_diff(current: DataFrame, previous: DataFrame, id: str, hash: str = "content_hash") -> DataFrame:
    """Plain comparison of two snapshots by row hash: created, updated, unchanged or vanished."""
    now = current.select(id, F.col(hash).alias("_now"))
    old = previous.select(id, F.col(hash).alias("_old"))
    action = (
        F.when(F.col("_old").isNull(), F.lit("created"))
        .when(F.col("_now").isNull(), F.lit("vanished"))
        .when(F.col("_now") == F.col("_old"), F.lit("unchanged"))
        .otherwise(F.lit("updated"))
    )
    return now.join(old, id, "full").select(id, action.alias("action"))


def keep_first_seen(items: DataFrame, known: DataFrame, key: Sequence[str]) -> DataFrame:
    """Keep the first-seen date an item already has."""
    before = known.select(*key, F.col("first_seen").alias("_first"))
    return items.join(before, list(key), "left").withColumn("first_seen", F.coalesce("_first", "first_seen")).drop("_first")


def item_grace(
    present: DataFrame,
    known: DataFrame,
    fresh: DataFrame,
    entity: str,
    item: str,
    limit: int = ITEM_MISS_LIMIT,
) -> DataFrame:
    """(entity, item, action, misses, first_seen) after one run.

    ``known`` has first_seen, misses and ``has_row`` (is the old item row
    still readable?). Only entities in ``fresh`` count misses: an item absent
    there stays for ``limit`` - 1 runs and is then removed, at once when its
    old row is lost. Items of other entities are carried as they were.
    """
    now = present.select(entity, item, F.col("first_seen").alias("_new_first"), F.lit(True).alias("_now"))
    old = known.select(
        entity,
        item,
        F.col("first_seen").alias("_first"),
        F.coalesce("misses", F.lit(0)).alias("_misses"),
        F.coalesce("has_row", F.lit(True)).alias("_has_row"),
        F.lit(True).alias("_old"),
    )
    looked = fresh.select(entity).distinct().withColumn("_fresh", F.lit(True))
    both = now.join(old, [entity, item], "full").join(looked, entity, "left")
    waits = (F.col("_misses") + 1 < limit) & F.col("_has_row")
    action = (
        F.when(_yes(F.col("_now")), F.when(_yes(F.col("_old")), F.lit("kept")).otherwise(F.lit("added")))
        .when(~_yes(F.col("_fresh")), F.lit("carried"))
        .when(waits, F.lit("grace"))
        .otherwise(F.lit("removed"))
    )
    return both.withColumn("action", action).select(
        entity,
        item,
        "action",
        F.when(F.col("action") == "carried", F.col("_misses"))
        .when(F.col("action") == "grace", F.col("_misses") + 1)
        .otherwise(F.lit(0))
        .alias("misses"),
        F.coalesce("_first", "_new_first").alias("first_seen"),
    )


LADDER = ("created", "carried", "returned", "hidden", "still-hidden", "deleted")


def number_runs(observations: DataFrame, run: Column) -> DataFrame:
    """(run, run_no): runs numbered densely from 0. One row per run, so one task is enough."""
    runs = observations.select(run.alias("run")).distinct()
    return runs.withColumn("run_no", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("run")) - 1)


def lifecycle_replay(
    observations: DataFrame,
    entity: Sequence[str],
    run_no: Column,
    last_run: int | Column,
    limit: int,
    labels: Sequence[str] = LADDER,
) -> DataFrame:
    """(entity, run_no, action) for every run from the first sighting, as the ladder would set it.

    Observations shrink to one row per entity and run before they are
    shuffled, so a busy entity has at most as many rows as there are runs.
    After its last sighting an entity gets at most ``limit`` rows.
    """
    created, carried, returned, hidden, still_hidden, deleted = labels
    seen = observations.select(*entity, run_no.cast("bigint").alias("run_no")).distinct()
    order = Window.partitionBy(*entity).orderBy("run_no")
    gap = F.col("run_no") - F.col("_before")
    last = F.lit(last_run) if isinstance(last_run, int) else last_run
    end = F.least(F.coalesce(F.lead("run_no").over(order) - 1, last), F.col("run_no") + limit)
    spans = seen.withColumn("_before", F.lag("run_no").over(order)).withColumn("_end", end)
    sighting = (
        F.when(F.col("_before").isNull() | (gap > limit), F.lit(created))
        .when(gap == 1, F.lit(carried))
        .otherwise(F.lit(returned))
    )
    each = spans.withColumn("_first", sighting).select(
        *entity, "_first", F.col("run_no").alias("_seen"), F.explode(F.sequence("run_no", "_end")).alias("run_no")
    )
    missed = F.col("run_no") - F.col("_seen")
    action = (
        F.when(missed == 0, F.col("_first"))
        .when(missed == limit, F.lit(deleted))
        .when(missed == 1, F.lit(hidden))
        .otherwise(F.lit(still_hidden))
    )
    return each.select(*entity, "run_no", action.alias("action"))


def freshness_due(ok: Column, last: Column, now: Column, days: float = FRESHNESS_DAYS) -> Column:
    """Should an unchanged entity get a new "last crawled" date?"""
    return ok & (last.isNull() | _yes(days_between(last, now) >= days))
