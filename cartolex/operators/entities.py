"""Raw items to stable item rows, facets and entity documents."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cartolex.functions.attributes import parse_process, parse_roast
from cartolex.functions.geo import geohash
from cartolex.functions.numbers import valid_range
from cartolex.functions.text import normalize_text, normalize_variety, short_hash
from cartolex.functions.variant import short_text
from cartolex.operators.keep import cap_per_group, keep_first
from cartolex.operators.lexicon import lexicon_map
from cartolex.vocab.countries import COUNTRIES
from cartolex.vocab.enums import (
    FLAVOR_FAMILIES,
    MENU_CATEGORIES,
)
from cartolex.vocab.rules import STORE_PLATFORMS


def _empty() -> Column:
    return F.array().cast("array<string>")


def item_id(entity: Column, name: Column) -> Column:
    """Stable id: the same item of an entity keeps it when spelling details change."""
    return short_hash(F.concat_ws("|", entity, normalize_text(name)))


def menu_id(entity: Column, name: Column, category: Column) -> Column:
    return short_hash(F.concat_ws("|", entity, F.lit("menu"), normalize_text(name), category))


def note_families(items: DataFrame, id: str, notes: Column, lexicon: DataFrame) -> tuple[DataFrame, DataFrame]:
    """((id, families), (id, pos, note) unmapped): families of each item's notes in the order found.

    The same notes occur on very many items, so each distinct note is mapped
    once and joined back.
    """
    singles = items.select(F.col(id), F.posexplode(notes).alias("pos", "note")).filter("note IS NOT NULL")
    mapped = lexicon_map(singles.select("note").distinct(), "note", F.col("note"), lexicon)
    found = singles.join(mapped, "note")
    in_order = F.array_sort(F.collect_list(F.struct("pos", "values")))
    families = found.groupBy(id).agg(
        F.array_distinct(F.flatten(F.transform(in_order, lambda n: n["values"]))).alias("families")
    )
    return families, singles.join(mapped, "note", "left_anti").select(id, "pos", "note")


def normalize_items(
    raw: DataFrame, key: str, entity: str, lexicon: DataFrame, seen_at: Column, name_chars: int | None = None, most_notes: int | None = None
) -> DataFrame:
    """Raw items (see ``enrich.ITEM_FIELDS``, unique ``key``) to published item rows.

    ``raw`` is read once for its notes and once for the rest; hand over a stored table.
    """
    notes = F.coalesce(F.col("notes"), _empty())
    families, _ = note_families(raw, key, notes, lexicon)
    known = list(COUNTRIES)
    countries = F.array_distinct(
        F.filter(F.transform(F.coalesce("countries", _empty()), F.upper), lambda c: c.isin(known))
    )
    varieties = F.filter(F.transform(F.coalesce("varieties", _empty()), normalize_variety), lambda v: v != "")
    suggested = F.filter(F.coalesce("flavor_families", _empty()), lambda f: f.isin(list(FLAVOR_FAMILIES)))
    joined = raw.join(families, key, "left").withColumn("_countries", countries)
    return joined.select(
        F.col(key),
        F.col(entity),
        item_id(F.col(entity), F.col("name")).alias("item_id"),
        short_text(F.col("name"), name_chars).alias("name"),
        "url",
        F.col("_countries").alias("countries"),
        "region",
        "farm",
        "producer",
        F.coalesce("is_blend", F.size("_countries") > 1).alias("is_blend"),
        parse_process(F.col("process")).alias("process"),
        parse_roast(F.col("roast")).alias("roast_level"),
        F.array_distinct(varieties).alias("varieties"),
        F.coalesce("is_decaf", F.lit(False)).alias("is_decaf"),
        (notes if most_notes is None else F.slice(notes, 1, most_notes)).alias("notes"),
        F.array_union(F.coalesce("families", _empty()), suggested).alias("flavor_families"),
        valid_range(F.col("price_usd"), 3, 500).alias("price_usd"),
        valid_range(F.col("size_grams"), 50, 5000).alias("size_grams"),
        "in_stock",
        "source",
        F.to_date(seen_at).alias("first_seen"),
        seen_at.alias("last_seen"),
    )


def normalize_menu(raw: DataFrame, entity: str, order: Sequence[str], seen_at: Column, name_chars: int | None = None) -> DataFrame:
    known = F.when(F.col("category").isin(list(MENU_CATEGORIES)), F.col("category")).otherwise(F.lit("other"))
    return raw.select(
        F.col(entity),
        *order,
        menu_id(F.col(entity), F.col("name"), known).alias("menu_id"),
        short_text(F.col("name"), name_chars).alias("name"),
        known.alias("category"),
        valid_range(F.col("price_usd"), 0.5, 100).alias("price_usd"),
        "description",
        "source",
        seen_at.alias("last_seen"),
    )


def finalise_items(
    items: DataFrame, entity: str, order: Sequence[str], most: int | None = None
) -> DataFrame:
    """One row per item id (the first); of each entity the first ``most``, in-stock items before others, if that is given."""
    unique = keep_first(items, [entity, "item_id"], list(order))
    if most is None:
        return unique
    sold_out = ~F.coalesce(F.col("in_stock"), F.lit(True))
    return cap_per_group(unique, [entity], [sold_out, *[F.col(o) for o in order]], most)


def finalise_menu(menu: DataFrame, entity: str, order: Sequence[str], most: int | None = None) -> DataFrame:
    unique = keep_first(menu, [entity, "menu_id"], list(order))
    if most is None:
        return unique
    return cap_per_group(unique, [entity], [F.col(o) for o in order], most)


def sorted_set(c: Column) -> Column:
    return F.array_sort(F.collect_set(c))


def sorted_union(c: Column) -> Column:
    """Sorted distinct members of an array column over the group."""
    return F.array_sort(F.array_distinct(F.flatten(F.collect_set(c))))


def facet_aggregates(
    sets: dict[str, Column], unions: dict[str, Column], any_url: Column, decaf: Column
) -> list[Column]:
    """Aggregates behind ``compute_facets``; all combine before the shuffle."""
    return [
        F.count("*").alias("bean_count"),
        F.coalesce(F.bool_or(any_url), F.lit(False)).alias("_any_url"),
        *[sorted_set(c).alias(n) for n, c in sets.items()],
        *[sorted_union(c).alias(n) for n, c in unions.items()],
        F.coalesce(F.bool_or(decaf), F.lit(False)).alias("has_decaf"),
    ]


ITEM_SETS = {"roast_levels": "roast_level", "processes": "process"}
ITEM_UNIONS = {
    "origin_countries": "countries",
    "flavor_families": "flavor_families",
    "varieties": "varieties",
}
FACET_SETS = [*ITEM_SETS, *ITEM_UNIONS]


def compute_facets(
    entities: DataFrame,
    items: DataFrame,
    menu: DataFrame | None,
    entity: str,
    platform: Column,
    sets: dict[str, Column] | None = None,
    unions: dict[str, Column] | None = None,
    url: Column | None = None,
    decaf: Column | None = None,
) -> DataFrame:
    """Entities with status, item count, sells-online flag, sorted facet sets and the decaf flag."""
    sets = {n: F.col(c) for n, c in ITEM_SETS.items()} if sets is None else sets
    unions = {n: F.col(c) for n, c in ITEM_UNIONS.items()} if unions is None else unions
    url = F.col("url") if url is None else url
    decaf = F.col("is_decaf") if decaf is None else decaf
    per_entity = items.groupBy(entity).agg(*facet_aggregates(sets, unions, F.coalesce(url, F.lit("")) != "", decaf))
    return attach_facets(entities, per_entity, menu, entity, platform, [*sets, *unions])


def attach_facets(entities: DataFrame, per_entity: DataFrame, menu: DataFrame | None, entity: str, platform: Column, names: Sequence[str]) -> DataFrame:
    """Entities joined to their facets (``bean_count``, ``_any_url``, ``names``, ``has_decaf``), with what follows from them."""
    out = entities.join(per_entity, entity, "left")
    if menu is None:
        out = out.withColumn("_menu", F.lit(False))
    else:
        with_menu = menu.select(entity).distinct().withColumn("_menu", F.lit(True))
        out = out.join(with_menu, entity, "left")
    has_items = F.coalesce(F.col("bean_count"), F.lit(0)) > 0
    sells = has_items & (F.coalesce(platform.isin(list(STORE_PLATFORMS)), F.lit(False)) | F.coalesce("_any_url", F.lit(False)))
    status = F.when(has_items, F.lit("beans")).when(F.coalesce("_menu", F.lit(False)), F.lit("menu-only")).otherwise(F.lit("none"))
    return out.withColumns(
        {
            "data_status": status,
            "bean_count": F.coalesce("bean_count", F.lit(0)).cast("bigint"),
            "sells_online": sells,
            **{n: F.coalesce(F.col(n), _empty()) for n in names},
            "has_decaf": F.coalesce("has_decaf", F.lit(False)),
        }
    ).drop("_any_url", "_menu")


def build_entities(
    candidates: DataFrame, items: DataFrame, menu: DataFrame, id: str = "id", entity: str = "entity_id"
) -> DataFrame:
    """Entity rows out of candidates (with ``platform``) and their finalised items and menu."""
    keyed = candidates.withColumnRenamed(id, entity)
    faceted = compute_facets(keyed, items, menu, entity, F.col("platform"))
    upgraded = (F.col("kind") == "cafe") & (F.col("bean_count") > 0) & F.col("sells_online")
    return faceted.withColumns(
        {
            "kind": F.when(upgraded, F.lit("both")).otherwise(F.col("kind")),
            "geohash": geohash(F.col("lat"), F.col("lng"), 9),
        }
    ).withColumnRenamed(entity, id)


SUMMARY = ["id", "name", "kind", "lat", "lng", "data_status", "bean_count", "sells_online", *FACET_SETS, "has_decaf"]


def to_summary(entities: DataFrame) -> DataFrame:
    """Index projection."""
    return entities.select(*SUMMARY)


def nest(parents: DataFrame, id: str, children: DataFrame, entity: str, order: Sequence[str], fields: Sequence[str], as_name: str) -> DataFrame:
    """Attach each entity's (already capped) child rows as an array of structs in ``order``."""
    packed = F.struct(F.struct(*[F.col(o) for o in order]).alias("o"), F.struct(*[F.col(f) for f in fields]).alias("row"))
    lists = children.groupBy(F.col(entity).alias(id)).agg(
        F.transform(F.array_sort(F.collect_list(packed)), lambda p: p["row"]).alias(as_name)
    )
    joined = parents.join(lists, id, "left")
    return joined.withColumn(as_name, F.coalesce(F.col(as_name), F.array().cast(joined.schema[as_name].dataType)))
