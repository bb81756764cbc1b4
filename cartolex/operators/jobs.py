"""Extraction work: planning, prompt packing and outcome assembly."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cartolex.operators.corpus import page_usable
from cartolex.operators.running import with_running
from cartolex.vocab.enums import CONTEXT_CHARS

# Page kinds by use, in the order a job reads them. Fixed values.
ITEM_KINDS = ("coffee", "shop")
MENU_KINDS = ("menu", "pdf")
HOME_KINDS = ("home",)


def _one_of(kinds: Sequence[str]) -> Column:
    return F.col("kind").isin(list(kinds))


def plan_jobs(
    entities: DataFrame,
    pages: DataFrame,
    id: str,
    item_kinds: Sequence[str] = ITEM_KINDS,
    menu_kinds: Sequence[str] = MENU_KINDS,
    home_kinds: Sequence[str] = HOME_KINDS,
) -> DataFrame:
    """(id, mode, priority) in call order for entities with readable pages.

    ``entities``: id, status, has_items. ``pages``: id, kind, text. Without
    items, item pages give priority 1 and menu or home pages 3, both for a full
    extraction; with items, menu pages give priority 2 for the menu only.
    """
    usable = pages.filter(page_usable(F.col("text"), F.col("kind")))
    present = usable.groupBy(id).agg(
        F.bool_or(_one_of(item_kinds)).alias("_items"),
        F.bool_or(_one_of(menu_kinds)).alias("_menu"),
        F.bool_or(_one_of(home_kinds)).alias("_home"),
    )
    stocked = F.coalesce(F.col("has_items"), F.lit(False))
    priority = (
        F.when(~stocked & F.col("_items"), 1)
        .when(stocked & F.col("_menu"), 2)
        .when(~stocked & (F.col("_menu") | F.col("_home")), 3)
    )
    jobs = entities.filter(F.col("status") == "ok").join(present, id).withColumn("priority", priority)
    return (
        jobs.filter("priority IS NOT NULL")
        .select(id, F.when(F.col("priority") == 2, F.lit("menu")).otherwise(F.lit("both")).alias("mode"), "priority")
        .orderBy("priority", id)
    )


def job_pages(
    jobs: DataFrame,
    pages: DataFrame,
    id: str,
    item_kinds: Sequence[str] = ITEM_KINDS,
    menu_kinds: Sequence[str] = MENU_KINDS,
    home_kinds: Sequence[str] = HOME_KINDS,
) -> DataFrame:
    """The pages of each job with ``section``: item pages come first, then menu, then home."""
    section = F.when(_one_of(item_kinds), 0).when(_one_of(menu_kinds), 1).when(_one_of(home_kinds), 2)
    wanted = (
        (F.col("priority") == 1) & F.col("section").isNotNull()
        | (F.col("priority") == 2) & (F.col("section") == 1)
        | (F.col("priority") == 3) & F.col("section").isin(1, 2)
    )
    usable = pages.filter(page_usable(F.col("text"), F.col("kind"))).withColumn("section", section)
    return usable.join(jobs.select(id, "mode", "priority"), id).filter(wanted)


def pack_context(
    pages: DataFrame,
    group: str,
    order: Sequence[str],
    text: str,
    budget: int = CONTEXT_CHARS,
    header: Column | None = None,
    joiner: str = "\n\n",
    chunk: Column | None = None,
) -> DataFrame:
    """(group, pieces, chars, context): texts in order up to ``budget`` characters.

    The text that crosses the budget is cut, later ones are left out. Empty
    texts are left out too, so a group holds at most ``budget`` pieces.
    """
    readable = pages.filter(F.length(text) > 0).withColumn("_chars", F.length(text).cast("bigint"))
    run = with_running(readable, order, [group], F.col("_chars"), chunk).filter(F.col("before") < budget)
    piece = F.substring(F.col(text), F.lit(1), (F.lit(budget) - F.col("before")).cast("int"))
    cut = run.withColumn("_piece", piece)
    body = F.col("_piece") if header is None else F.concat_ws("\n", header, F.col("_piece"))
    packed = cut.groupBy(group).agg(
        F.count("*").alias("pieces"),
        F.sum(F.length("_piece")).alias("chars"),
        F.array_sort(F.collect_list(F.struct("position", body.alias("body")))).alias("_parts"),
    )
    context = F.array_join(F.transform("_parts", lambda p: p["body"]), joiner)
    return packed.select(group, "pieces", "chars", context.alias("context"))


def assemble_outcomes(
    crawls: DataFrame, changed: DataFrame, store_items: DataFrame, jobs: DataFrame, results: DataFrame, id: str
) -> DataFrame:
    """Crawls with ``fresh``, ``menu_fresh`` and ``item_source``.

    ``store_items`` and ``results`` hold one row per id with items from the
    catalogue, or with an answered job. Unchanged pages, or a planned job
    without an answer and no catalogue items, are not fresh and are retried.
    """
    mark = lambda df, name: df.select(id).distinct().withColumn(name, F.lit(True))
    joined = (
        crawls.join(mark(changed, "_changed"), id, "left")
        .join(mark(store_items, "_store"), id, "left")
        .join(jobs.select(id, F.col("mode").alias("_mode")), id, "left")
        .join(mark(results, "_answer"), id, "left")
    )
    has = lambda c: F.coalesce(F.col(c), F.lit(False))
    waiting = F.col("_mode").isNotNull() & ~has("_answer")
    fresh = has("_changed") & (has("_store") | ~waiting)
    menu_fresh = F.when(has("_store"), F.col("_mode").isNull() | (F.col("_mode") == "beans") | has("_answer")).otherwise(True)
    source = F.when(has("_store"), F.lit("store")).when(has("_answer"), F.lit("model"))
    return (
        joined.withColumn("fresh", fresh)
        .withColumn("menu_fresh", F.when(F.col("fresh"), menu_fresh))
        .withColumn("item_source", F.when(F.col("fresh"), source))
        .drop("_changed", "_store", "_mode", "_answer")
    )
