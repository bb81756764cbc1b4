"""One run for a region: discover, detect changes, extract, normalise, publish."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cartolex.functions.hashing import content_hash
from cartolex.functions.numbers import json_bytes
from cartolex.operators.budget import fit_bytes
from cartolex.operators.catalog import flatten_catalogs, validate_items, validate_menu
from cartolex.operators.changes import changed_pages, classify_changes, freshness_due, item_grace, meta_hash
from cartolex.operators.corpus import pages_hash
from cartolex.operators.discover import curate
from cartolex.operators.enrich import enrich_items, with_item_fields
from cartolex.operators.entities import (
    build_entities,
    finalise_items,
    finalise_menu,
    nest,
    normalize_items,
    normalize_menu,
    to_summary,
)
from cartolex.operators.jobs import assemble_outcomes, plan_jobs
from cartolex.operators.keep import take_budget
from cartolex.operators.report import count_by, failed_ratio, run_report
from cartolex.session import durable
from cartolex.sources.catalog import read_catalog_json
from cartolex.vocab import enums

STATE_SCHEMA = (
    "id string, content_hash string, pages_hash string, meta_hash string, crawl_status string, "
    "hidden_runs int, last_crawled_at timestamp"
)


@dataclass
class Inputs:
    """Tables of one run.

    ``flat``: cleaned place rows. ``crawls``: id, status, platform. ``pages``:
    id, pos, url, kind, text, hash (``text`` is the body for catalogue pages).
    ``responses``: id, response. ``deny``, ``hide``, ``patch``, ``add``:
    configuration. ``notes`` and ``countries``: lexicons. ``state``, ``items``,
    ``menu`` and ``index``: what the previous run returned, or None.
    """

    flat: DataFrame
    crawls: DataFrame
    pages: DataFrame
    responses: DataFrame
    deny: DataFrame
    hide: DataFrame
    patch: DataFrame
    add: DataFrame
    notes: DataFrame
    countries: DataFrame
    state: DataFrame | None = None
    items: DataFrame | None = None
    menu: DataFrame | None = None
    index: DataFrame | None = None
    options: dict = field(default_factory=dict)


def _store_items(pages: DataFrame, changed: DataFrame) -> DataFrame:
    """Items of the changed sites' catalogue pages."""
    home = F.min_by(F.regexp_extract("url", r"^([^:]+://[^/?#]*)", 1), "pos")
    origins = pages.filter("kind = 'home'").groupBy("id").agg(home.alias("origin"))
    bodies = (
        pages.filter("kind = 'products-json'")
        .join(changed.select("id", "platform"), "id")
        .join(origins, "id", "left")
        .select("id", "platform", F.coalesce("origin", F.lit("")).alias("origin"), "pos", F.col("text").alias("body"))
    )
    products = read_catalog_json(bodies).filter("(platform = 'shopify' AND layout = 'a') OR (platform = 'woocommerce' AND layout = 'b')")
    return flatten_catalogs(products, "id", F.col("origin"), ["pos", "product_pos"], description_chars=enums.DESCRIPTION_CHARS)


def refresh_region(
    t: Inputs, region_id: str, now: Column, complete: bool = True, call_budget: int = 400
) -> dict[str, DataFrame]:
    """All tables after the run: candidates, drops, jobs, skipped, documents, items, menu, actions, state, index, report."""
    spark = t.flat.sparkSession
    state = t.state if t.state is not None else spark.createDataFrame([], STATE_SCHEMA)
    candidates, drops = curate(t.flat, region_id, deny=t.deny, hide=t.hide, patch=t.patch, add=t.add, **t.options)
    candidates = durable(candidates)
    found = t.crawls.select("id", "status", F.col("platform").alias("found_platform"))
    crawls = (
        candidates.select("id", F.col("platform").alias("pinned"))
        .join(found, "id", "left")
        .join(pages_hash(t.pages, "id"), "id", "left")
        .select(
            "id",
            F.coalesce("status", F.lit("no-site")).alias("status"),
            F.coalesce("pinned", "found_platform", F.lit("unknown")).alias("platform"),
            F.coalesce("pages_hash", F.lit("")).alias("pages_hash"),
        )
    )
    crawls = durable(crawls)

    # Only changed sites go through the heavy text work.
    changed = changed_pages(crawls, state, "id")
    raw_store = _store_items(t.pages, changed).withColumn("key", F.concat_ws("/", "id", F.lower("name")))
    store = durable(enrich_items(with_item_fields(durable(raw_store)), "key", t.countries))
    stocked = store.select("id").distinct().withColumn("has_items", F.lit(True))
    jobs = plan_jobs(changed.join(stocked, "id", "left"), t.pages, "id")
    taken, skipped = take_budget(jobs, ["priority", "id"], call_budget, "id")
    taken = durable(taken)
    answered = t.responses.join(taken.select("id", "mode"), "id")
    outcomes = durable(assemble_outcomes(crawls, changed, store, jobs, answered, "id"))
    fresh = outcomes.filter("fresh")

    by = lambda source: fresh.filter(F.col("item_source") == source).select("id")
    model = with_item_fields(validate_items(answered, "id", enums.ITEM_LIMITS)).withColumn(
        "key", F.concat_ws("#", "id", F.col("pos").cast("string"))
    )
    fields = [c for c in with_item_fields(model).columns if c not in ("id", "key", "pos")]
    raw = (
        store.join(by("store"), "id", "left_semi")
        .select("id", "key", F.col("product_pos").alias("pos"), *fields)
        .unionByName(model.join(by("model"), "id", "left_semi").select("id", "key", "pos", *fields))
    )
    raw = durable(raw)
    listed = normalize_items(raw.withColumnRenamed("id", "entity_id"), "key", "entity_id", t.notes, now, enums.ITEM_NAME_CHARS, enums.MAX_NOTES_PER_ITEM)
    listed = durable(listed.join(raw.select("key", "pos"), "key").drop("key"))

    known = t.items if t.items is not None else listed.limit(0).withColumn("misses", F.lit(0))
    fates = item_grace(listed, known.withColumn("has_row", F.lit(True)), fresh.select(F.col("id").alias("entity_id")), "entity_id", "item_id")
    fates = durable(fates)
    fate = fates.select("entity_id", "item_id", "action", F.col("misses").alias("_misses"), F.col("first_seen").alias("_first"))
    key = ["entity_id", "item_id"]
    present = listed.join(fate.filter("action IN ('kept', 'added')"), key).withColumn("first_seen", F.col("_first"))
    waiting = known.drop("misses").join(fate.filter("action IN ('grace', 'carried')"), key)
    both = present.unionByName(waiting, allowMissingColumns=True).withColumn("misses", F.col("_misses"))
    late = F.when(F.col("action") == "grace", 1).otherwise(0)
    items = finalise_items(both.withColumn("late", late), "entity_id", ["late", "pos", "item_id"], enums.MAX_ITEMS_PER_ENTITY)
    items = durable(items.drop("late", "action", "_misses", "_first"))

    new_menu = validate_menu(answered, "id", enums.MENU_LIMITS).join(fresh.filter("menu_fresh").select("id"), "id", "left_semi")
    menu = normalize_menu(new_menu.withColumnRenamed("id", "entity_id"), "entity_id", ["pos"], now, enums.MENU_NAME_CHARS)
    if t.menu is not None:
        replaced = fresh.filter("menu_fresh").select(F.col("id").alias("entity_id"))
        menu = menu.unionByName(t.menu.join(replaced, "entity_id", "left_anti"))
    menu = durable(finalise_menu(menu, "entity_id", ["pos", "menu_id"], enums.MAX_MENU_PER_ENTITY))

    placed = candidates.drop("platform").join(crawls.select("id", "platform", F.col("status").alias("crawl_status")), "id")
    entities = build_entities(placed, items, menu)
    item_fields = [c for c in items.columns if c not in ("entity_id", "pos", "misses")]
    menu_fields = [c for c in menu.columns if c not in ("entity_id", "pos")]
    nested = nest(entities, "id", items, "entity_id", ["pos", "item_id"], item_fields, "items")
    nested = nest(nested, "id", menu, "entity_id", ["pos", "menu_id"], menu_fields, "dishes")
    bare = json_bytes(*[F.col(c) for c in entities.columns]) + F.lit(len(',"items":[],"dishes":[]'))
    documents = fit_bytes(nested, ["items", "dishes"], bare)
    hashed = documents.withColumn("content_hash", content_hash(documents.drop("trimmed"))).withColumn(
        "meta_hash", meta_hash(F.col("crawl_status"))
    )
    documents = durable(hashed)

    current = documents.select("id", "content_hash", "meta_hash").join(outcomes.select("id", "fresh"), "id")
    previous = state.select("id", "content_hash", "meta_hash", "hidden_runs")
    indexed = t.index.select("id").withColumn("in_index", F.lit(True)) if t.index is not None else None
    if indexed is None:
        previous = previous.withColumn("in_index", F.lit(False))
    else:
        previous = previous.join(indexed, "id", "left").withColumn("in_index", F.coalesce("in_index", F.lit(False)))
    actions = durable(classify_changes(current, previous.withColumn("has_document", F.lit(True)), "id", complete))

    old = state.select(*[F.col(c).alias(c if c == "id" else f"_{c}") for c in state.columns])
    merged = (
        actions.filter("action <> 'deleted'")
        .join(documents.select("id", "content_hash", "meta_hash", "crawl_status"), "id", "left")
        .join(outcomes.select("id", "fresh", "menu_fresh", "pages_hash"), "id", "left")
        .join(old, "id", "left")
    )
    vanished = F.col("action").isin("hidden", "still-hidden", "kept")
    written = F.col("action").isin("created", "updated")
    due = freshness_due(F.col("crawl_status") == "ok", F.col("_last_crawled_at"), now)
    next_state = merged.select(
        "id",
        F.when(F.col("action").isin("hidden", "still-hidden"), F.lit(""))
        .when(vanished, F.col("_content_hash"))
        .otherwise(F.col("content_hash"))
        .alias("content_hash"),
        # An incomplete extraction leaves no fingerprint, so that it is tried again.
        F.when(F.col("fresh"), F.when(F.col("menu_fresh"), F.col("pages_hash")).otherwise(F.lit("")))
        .otherwise(F.coalesce("_pages_hash", F.lit("")))
        .alias("pages_hash"),
        F.coalesce("meta_hash", "_meta_hash").alias("meta_hash"),
        F.coalesce("crawl_status", "_crawl_status").alias("crawl_status"),
        F.col("hidden_runs").cast("int").alias("hidden_runs"),
        F.when((F.col("crawl_status") == "ok") & (written | due), now)
        .otherwise(F.col("_last_crawled_at"))
        .alias("last_crawled_at"),
    )
    index = to_summary(documents)
    if t.index is not None:
        untouched = t.index.join(actions.filter("action = 'kept'").select("id"), "id", "left_semi")
        index = index.unionByName(untouched)
    sited = outcomes.select("id", "status", "platform")
    report = run_report(
        [
            count_by(drops, "dropped", F.col("reason")),
            count_by(sited, "crawl", F.col("status")),
            count_by(sited.filter("status = 'ok'"), "platforms", F.col("platform")),
            count_by(jobs, "jobs", F.concat(F.lit("priority "), F.col("priority").cast("string"))),
            count_by(actions, "publish", F.col("action")),
            count_by(fates, "items", F.col("action")),
        ]
    )
    return {
        "candidates": candidates,
        "drops": drops,
        "jobs": taken,
        "skipped": skipped,
        "documents": documents,
        "items": items,
        "menu": menu,
        "actions": actions,
        "state": next_state,
        "index": index,
        "report": report,
        "failures": failed_ratio(sited),
    }
