"""Facets and the read side, on customers and their order lines."""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bindings import ORACLES, query, table
from bindings.shared import BOX, FACET_LISTS, INDEX_SQL, ITEMS_SQL, ORIGIN, case, entities_of, index, indexed, items, km, values
from cartolex.functions import display
from cartolex.functions.geo import haversine_km, in_box
from cartolex.functions.taxonomy import top_of
from cartolex.operators.bitmaps import count_by_bitmaps, filter_by_bitmaps, write_facet_index
from cartolex.operators.entities import FACET_SETS, attach_facets
from cartolex.operators.facet_state import facets_of, member_change, member_counts, merge_counts
from cartolex.operators.facets import (
    Filters,
    alias_matches,
    apply_filters,
    count_matching,
    facet_options,
    group_by_continent,
    item_matches,
    kind_matches,
    options_for,
    overlaps,
    taxonomy_matches,
    tier,
)
from cartolex.operators.report import group_menu
from cartolex.plans.search import search
from cartolex.session import durable, ensure_checkpoint_dir
from cartolex.sources.dims import country_dim
from cartolex.sources.export import to_geojson
from cartolex.sources.snapshots import lookup_entity, region_counts
from cartolex.vocab.countries import CONTINENTS, COUNTRIES
from cartolex.vocab.enums import MENU_CATEGORIES

X0, Y0 = ORIGIN
_TIER = "CASE data_status WHEN 'beans' THEN 0 WHEN 'menu-only' THEN 1 ELSE 2 END"
_KM = km(str(X0), str(Y0), "lng", "lat")
SELECTION = Filters(
    kinds=["roaster"],
    sells_online=True,
    roast_levels=["light", "dark"],
    processes=["washed"],
    origin_countries=["ET", "KE", "CI"],
    flavor_families=["red", "blue/bolt"],
    varieties=["Brand 3", "BRAND#11", "brand#20"],
    decaf_only=True,
)
SELECTION_SQL = """kind IN ('roaster', 'both') AND sells_online AND data_status = 'beans'
  AND list_has_any(roast_levels, ['light', 'dark']) AND list_contains(processes, 'washed')
  AND list_has_any(origin_countries, ['ET', 'KE', 'CI'])
  AND len(list_filter(flavor_families, lambda f: f = 'red' OR f LIKE 'red/%' OR f = 'blue/bolt' OR f LIKE 'blue/bolt/%')) > 0
  AND list_has_any(varieties, ['brand#3', 'brand#11', 'brand#20']) AND has_decaf"""


@query(
    "flagship_search",
    f"""WITH {INDEX_SQL}
SELECT id, name, kind, {_TIER} AS tier, bean_count, round({_KM}, 6) AS km FROM facets
WHERE lng BETWEEN {BOX[0]} AND {BOX[2]} AND lat BETWEEN {BOX[1]} AND {BOX[3]}
  AND data_status = 'beans' AND list_has_any(roast_levels, ['light', 'dark'])
  AND len(list_filter(flavor_families, lambda f: f = 'red' OR f LIKE 'red/%')) > 0
""",
)
def flagship(spark, folder):
    near = index(spark, folder).filter(in_box(F.col("lng"), F.col("lat"), BOX))
    found = search(near, Filters(roast_levels=["light", "dark"], flavor_families=["red"]), ORIGIN)
    return found.select(
        "id", "name", "kind", tier(F.col("data_status")).alias("tier"), "bean_count", F.round("km", 6).alias("km")
    )


@query(
    "facets",
    f"""WITH {INDEX_SQL}
SELECT id, kind, data_status, bean_count, sells_online, has_decaf,
       {', '.join(f"array_to_string({c}, '|') AS {c}" for c in FACET_LISTS)} FROM facets""",
)
def facets(spark, folder):
    return shown_facets(index(spark, folder))


def shown_facets(entities):
    return entities.select(
        "id",
        "kind",
        "data_status",
        "bean_count",
        "sells_online",
        "has_decaf",
        *[F.array_join(c, "|").alias(c) for c in FACET_LISTS],
    )


@query("facets_kept", ORACLES["facets"])
def facets_kept(spark, folder):
    """Facets out of counts of an earlier day, when a fifth of the entities had other items, and ten changes since."""
    entity, group = "entity_id", F.col("entity_id") % 50
    now = items(spark, folder)
    # Earlier, items had other processes, some were missing, and some had gone since.
    earlier = now.filter("NOT is_decaf").withColumn("process", F.lit("other")).unionByName(now.withColumn("varieties", F.array(F.lit("gone"))))
    counts = merge_counts(entity, member_counts(now.filter(group >= 10), entity), member_counts(earlier.filter(group < 10), entity))
    before, after = member_counts(earlier.filter(group < 10), entity), member_counts(now.filter(group < 10), entity)
    # The changes of ten runs are read ten times, so they are worked out once.
    change = durable(member_change(before, after, entity))
    state = merge_counts(entity, counts, *[change.filter(group == n) for n in range(10)], together=True)
    customers, menu, platform = entities_of(spark, folder)
    kept = attach_facets(customers, facets_of(state, entity, FACET_SETS), menu, entity, platform, FACET_SETS)
    return shown_facets(indexed(kept))


@query(
    "facet_options",
    f"""WITH {INDEX_SQL}
{' UNION '.join(f"SELECT '{c}' AS dim, unnest({c}) AS value FROM facets" for c in FACET_LISTS)}
UNION SELECT 'has_decaf', 'true' FROM facets WHERE has_decaf""",
)
def options(spark, folder):
    return facet_options(index(spark, folder))


_COUNTRIES_SQL = values([(c, n, k) for c, (n, k) in COUNTRIES.items()])
_CONTINENT_ORD = "CASE " + " ".join(f"WHEN continent = '{c}' THEN {i}" for i, c in enumerate(CONTINENTS)) + f" ELSE {len(CONTINENTS)} END"


@query(
    "origin_options",
    f"""WITH {ITEMS_SQL},
present AS (SELECT DISTINCT unnest(countries) AS value FROM items UNION SELECT unnest(['BR', 'ZZ', 'ET']))
SELECT CAST({_CONTINENT_ORD} AS INTEGER) AS group_ord, coalesce(continent, 'Other') AS title, value, coalesce(name, value) AS label
FROM present LEFT JOIN {_COUNTRIES_SQL} AS c(code, name, continent) ON code = value""",
)
def origin_options(spark, folder):
    rows = options_for("origin", index(spark, folder), ["BR", "ZZ", "ET"], country_dim(spark))
    return rows.select("group_ord", "title", "value", "label")


@query(
    "variety_options",
    f"""WITH {ITEMS_SQL},
present AS (SELECT DISTINCT unnest(varieties) AS value FROM items)
SELECT 0 AS group_ord, 'Decaf' AS title, 'decaf' AS value, 'Has decaf' AS label
UNION ALL SELECT 1, 'Variety', value, upper(substr(value, 1, 1)) || substr(value, 2) FROM present
UNION ALL SELECT 1, 'Variety', 'gesha', 'Gesha'""",
)
def variety_options(spark, folder):
    rows = options_for("more", index(spark, folder), ["gesha", "brand#1"], country_dim(spark))
    return rows.select("group_ord", "title", "value", "label")


@query(
    "continent_groups",
    f"""WITH {ITEMS_SQL},
present AS (SELECT DISTINCT unnest(countries) AS value FROM items)
SELECT CAST({_CONTINENT_ORD} AS INTEGER) AS ord, coalesce(continent, 'Other') AS continent,
       string_agg(value, '|' ORDER BY coalesce(name, value)) AS codes
FROM present LEFT JOIN {_COUNTRIES_SQL} AS c(code, name, continent) ON code = value GROUP BY 1, 2""",
)
def continents(spark, folder):
    codes = items(spark, folder).select(F.explode("countries").alias("code"))
    grouped = group_by_continent(codes, country_dim(spark))
    return grouped.select("ord", "continent", F.array_join("codes", "|").alias("codes"))


@query("faceted_filter", f"WITH {INDEX_SQL} SELECT id, kind, bean_count FROM facets WHERE {SELECTION_SQL}")
def faceted(spark, folder):
    return apply_filters(index(spark, folder), SELECTION).select("id", "kind", "bean_count")


SELECTIONS = {
    "all": (Filters(), "TRUE"),
    "whole": (SELECTION, SELECTION_SQL),
    "kinds": (Filters(kinds=["cafe"], sells_online=True), "kind IN ('cafe', 'both') AND sells_online"),
    "notes": (
        Filters(flavor_families=["red"], roast_levels=["light"]),
        "data_status = 'beans' AND list_contains(roast_levels, 'light') AND len(list_filter(flavor_families, lambda f: f = 'red' OR f LIKE 'red/%')) > 0",
    ),
    "varieties": (Filters(varieties=["Brand 3"], decaf_only=True), "data_status = 'beans' AND list_contains(varieties, 'brand#3') AND has_decaf"),
}


def _bitmaps(spark, folder) -> str:
    path = f"{ensure_checkpoint_dir(spark)}/bitmaps-{uuid.uuid4().hex}"
    write_facet_index(index(spark, folder), path)
    return path


@query("bitmap_filter", f"WITH {INDEX_SQL} SELECT id, kind, bean_count FROM facets WHERE {SELECTIONS['notes'][1]}")
def bitmap_filter(spark, folder):
    return filter_by_bitmaps(spark, _bitmaps(spark, folder), SELECTIONS["notes"][0]).select("id", "kind", "bean_count")


@query(
    "bitmap_counts",
    f"WITH {INDEX_SQL} "
    + " UNION ALL ".join(f"SELECT '{name}' AS name, count(*) AS matching, {f.active} AS active FROM facets WHERE {sql}" for name, (f, sql) in SELECTIONS.items()),
)
def bitmap_counts(spark, folder):
    path = _bitmaps(spark, folder)
    counts = [count_by_bitmaps(spark, path, f).select(F.lit(name).alias("name"), "matching", "active") for name, (f, _) in SELECTIONS.items()]
    return reduce(DataFrame.unionByName, counts)


@query(
    "count_matching",
    f"WITH {INDEX_SQL} SELECT count(*) AS matching, 8 AS active FROM facets WHERE {SELECTION_SQL}",
)
def matching(spark, folder):
    return count_matching(index(spark, folder), SELECTION)


@query(
    "dimension_predicates",
    f"""WITH {INDEX_SQL}
SELECT id, kind IN ('cafe', 'both') AS kind_cafe, kind = 'both' AS kind_both,
       len(list_filter(flavor_families, lambda f: f = 'old' OR f LIKE 'old/%')) > 0 AS under_old,
       list_contains(flavor_families, 'old/rod') AS old_rod,
       list_has_any(varieties, ['brand#5', 'brand#6']) AS brand, list_has_any(processes, ['honey']) AS honey FROM facets""",
)
def predicates(spark, folder):
    families, varieties = F.col("flavor_families"), F.col("varieties")
    return index(spark, folder).select(
        "id",
        kind_matches(F.col("kind"), ["cafe"]).alias("kind_cafe"),
        kind_matches(F.col("kind"), ["both"]).alias("kind_both"),
        taxonomy_matches(families, ["old"]).alias("under_old"),
        taxonomy_matches(families, ["old/rod"]).alias("old_rod"),
        alias_matches(varieties, ["BRAND 5", "brand-6"]).alias("brand"),
        overlaps(F.col("processes"), ["honey"]).alias("honey"),
    )


ITEM_SELECTION = Filters(
    kinds=["cafe"], roast_levels=["light", "omni"], processes=["natural"], origin_countries=["ET", "IN"], decaf_only=True
)


@query(
    "item_matches",
    f"""WITH {ITEMS_SQL}
SELECT entity_id, count(*) AS items,
       count(*) FILTER (roast_level IN ('light', 'omni') AND process = 'natural' AND list_has_any(countries, ['ET', 'IN']) AND is_decaf) AS matching
FROM items GROUP BY 1""",
)
def matching_items(spark, folder):
    marked = items(spark, folder).withColumn("matches", item_matches(ITEM_SELECTION))
    return marked.groupBy("entity_id").agg(F.count("*").alias("items"), F.count_if("matches").alias("matching"))


@query(
    "tiered_top",
    f"""WITH {INDEX_SQL}
SELECT id, name, {_TIER} AS tier, round({_KM}, 6) AS km FROM facets ORDER BY tier, {_KM}, name, id LIMIT 100""",
)
def tiered(spark, folder):
    best = search(index(spark, folder), Filters(), ORIGIN, 100)
    return best.select("id", "name", tier(F.col("data_status")).alias("tier"), F.round("km", 6).alias("km"))


@query(
    "display_labels",
    f"""WITH {INDEX_SQL},
shown AS (SELECT *, {_KM} / 1.609344 AS miles, bean_count / 2.0 AS price, bean_count * 20.0 AS grams FROM facets)
SELECT id, CASE kind WHEN 'roaster' THEN 'Roaster' WHEN 'both' THEN 'Roaster + café' ELSE 'Café' END AS kind_label,
       CASE data_status WHEN 'beans' THEN bean_count || CASE WHEN bean_count = 1 THEN ' bean' ELSE ' beans' END
            WHEN 'menu-only' THEN 'Menu only' ELSE 'No bean info yet' END AS subtitle,
       CASE WHEN miles < 10 THEN format('{{:.1f}} mi', miles) ELSE CAST(floor(miles + 0.5) AS BIGINT) || ' mi' END AS distance,
       '$' || CASE WHEN bean_count % 2 = 0 THEN CAST(bean_count // 2 AS VARCHAR) ELSE bean_count // 2 || '.50' END
         || CASE WHEN grams = 0 THEN '' WHEN grams / 28.3495 >= 15.5
              THEN ' · ' || regexp_replace(format('{{:.1f}}', grams / 28.3495 / 16), '\\.0$', '') || ' lb'
              ELSE ' · ' || CAST(floor(grams / 28.3495 + 0.5) AS BIGINT) || ' oz' END AS price_label,
       array_to_string(list_distinct(list_transform(flavor_families[1:1], lambda f: split_part(f, '/', 1))), '|') AS first_family
FROM shown""",
)
def labels(spark, folder):
    rows = index(spark, folder).withColumn("km", haversine_km(F.lit(X0), F.lit(Y0), F.col("lng"), F.col("lat")))
    return rows.select(
        "id",
        display.kind_label(F.col("kind")).alias("kind_label"),
        display.row_subtitle(F.col("data_status"), F.col("bean_count")).alias("subtitle"),
        display.distance_label(F.col("km")).alias("distance"),
        display.price_label(F.col("bean_count") / 2.0, F.col("bean_count") * 20.0).alias("price_label"),
        F.array_join(F.transform(F.slice("flavor_families", 1, 1), top_of), "|").alias("first_family"),
    )


@query(
    "display_families",
    f"""WITH {INDEX_SQL}
SELECT id, array_to_string(list_sort(list_distinct(list_transform(flavor_families, lambda f: split_part(f, '/', 1)))), '|') AS families FROM facets""",
)
def families(spark, folder):
    """All top-level families; ``display_labels`` has the first only."""
    tops = F.array_distinct(F.transform("flavor_families", top_of))
    return index(spark, folder).select("id", F.array_join(F.array_sort(tops), "|").alias("families"))


@query(
    "item_labels",
    f"""WITH {ITEMS_SQL}
SELECT roast_level, CASE roast_level WHEN 'light' THEN 1 WHEN 'medium-light' THEN 2 WHEN 'medium' THEN 3 WHEN 'medium-dark' THEN 4
         WHEN 'dark' THEN 5 ELSE 3 END AS step,
       CASE WHEN is_decaf THEN coalesce(name_, code) || ' · ' || process ELSE coalesce(name_, code) END AS origin, count(*) AS n
FROM (SELECT *, countries[1] AS code FROM items) LEFT JOIN {values([(c, n) for c, (n, _) in COUNTRIES.items()])} AS c(iso, name_) ON iso = code
GROUP BY ALL""",
)
def item_labels(spark, folder):
    region = F.when(F.col("is_decaf"), F.col("process"))
    return (
        items(spark, folder)
        .select(
            "roast_level",
            display.roast_step(F.col("roast_level")).alias("step"),
            display.origin_label(F.col("countries"), F.col("is_decaf"), region).alias("origin"),
        )
        .groupBy("roast_level", "step", "origin")
        .agg(F.count("*").alias("n"))
    )


@query(
    "updated_labels",
    """
SELECT o_orderkey, CASE WHEN d <= 0 THEN 'Updated today' WHEN d = 1 THEN 'Updated yesterday' WHEN d < 14 THEN 'Updated ' || d || ' days ago'
  WHEN d < 60 THEN 'Updated ' || d // 7 || ' weeks ago' ELSE 'Updated ' || d // 30 || ' months ago' END AS label
FROM (SELECT o_orderkey, date_diff('day', CAST(o_orderdate AS DATE), DATE '1998-01-01') AS d FROM orders)""",
)
def updated(spark, folder):
    now = F.lit("1998-01-01 00:00:00").cast("timestamp_ntz")
    return table(spark, folder, "orders").select(
        "o_orderkey", display.updated_label(F.col("o_orderdate"), now).alias("label")
    )


@query(
    "geojson",
    f"""WITH {INDEX_SQL}
SELECT id, name, data_status AS status, CAST({_TIER} AS BIGINT) AS rank, round(lng, 9) AS x, round(lat, 9) AS y, 'Feature/Point' AS kind FROM facets""",
)
def geojson(spark, folder):
    rows = to_geojson(index(spark, folder)).withColumn("v", F.parse_json("feature"))
    at = lambda path, kind: F.variant_get("v", path, kind)
    return rows.select(
        at("$.id", "bigint").alias("id"),
        at("$.properties.name", "string").alias("name"),
        at("$.properties.status", "string").alias("status"),
        at("$.properties.rank", "bigint").alias("rank"),
        F.round(at("$.geometry.coordinates[0]", "double"), 9).alias("x"),
        F.round(at("$.geometry.coordinates[1]", "double"), 9).alias("y"),
        F.concat_ws("/", at("$.type", "string"), at("$.geometry.type", "string")).alias("kind"),
    )


MENU_OF_PRIORITY = {
    "1-URGENT": "espresso",
    "2-HIGH": "cold",
    "3-MEDIUM": "tea",
    "4-NOT SPECIFIED": "food",
    "5-LOW": "unlisted",
}


@query(
    "menu_groups",
    f"""
SELECT o_custkey AS entity_id, category, category_label,
       CAST(category_ord AS INTEGER) AS category_ord, count(*) AS dishes
FROM (SELECT *, {case('o_orderpriority', MENU_OF_PRIORITY)} AS cat FROM orders)
JOIN {values([(c, n, i) for i, (c, n) in enumerate(MENU_CATEGORIES.items())])} AS m(category, category_label, category_ord) ON category = cat
GROUP BY ALL""",
)
def menus(spark, folder):
    category = F
    for k, v in MENU_OF_PRIORITY.items():
        category = category.when(F.col("o_orderpriority") == k, F.lit(v))
    menu = table(spark, folder, "orders").select(
        F.col("o_custkey").alias("entity_id"), category.alias("category"), F.col("o_orderkey").alias("pos")
    )
    return (
        group_menu(menu, ["entity_id"], ["pos"])
        .groupBy("entity_id", "category", "category_label", "category_ord")
        .agg(F.count("*").alias("dishes"))
    )


@query("region_counts", f"WITH {INDEX_SQL} SELECT c_nationkey AS region_id, count(*) AS entities FROM facets GROUP BY 1")
def counts(spark, folder):
    return region_counts(index(spark, folder), "c_nationkey")


@query(
    "entity_lookup",
    f"WITH {INDEX_SQL} SELECT id, name, data_status FROM facets WHERE id = (SELECT max(c_custkey) FROM customer)",
)
def lookup(spark, folder):
    last = table(spark, folder, "customer").agg(F.max("c_custkey")).first()[0]
    return lookup_entity(index(spark, folder), "id", last).select("id", "name", "data_status")
