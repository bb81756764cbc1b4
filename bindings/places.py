"""Discovery operators on places derived from customers and parts."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from bindings import query, table
from bindings.shared import BOX, PLACES_SQL, km, lat, lat_sql, lng, lng_sql, norm, places
from cartolex.functions.geo import BASE32, haversine_km
from cartolex.functions.text import clean_url, host_of, normalize_text, path_of
from cartolex.operators.dedupe import nearest_anchor, spatial_dedupe
from cartolex.operators.discover import (
    apply_patch,
    denied_ids,
    detect_kind,
    drop_cascade,
    flag_ids,
    manual_additions,
    multi_location,
    project_candidate,
)
from cartolex.operators.grid import CLUSTER_MAX_ZOOM, bounds_of, geohash_cells, grid_clusters, nearest_region, regions_by_state
from cartolex.operators.pyramid import cluster_pyramid
from cartolex.session import ensure_checkpoint_dir
from cartolex.sources.places import coerce_places, inspect_categories, read_places, scan_bbox, write_places
from cartolex.vocab.regions import REGIONS

W, S, E, N = BOX


_BOX_SQL = f"""
SELECT CAST(c_custkey AS VARCHAR) AS id, c_name AS name, c_mktsegment AS category,
       round({lng_sql('c_custkey')}, 6) AS lng, round({lat_sql('c_custkey')}, 6) AS lat,
       n_name AS locality, array_to_string(CASE WHEN c_acctbal < 0 THEN [] ELSE [n_name] END, '|') AS alternates
FROM customer JOIN nation ON n_nationkey = c_nationkey
WHERE {lng_sql('c_custkey')} - 0.0001 >= {W} AND {lng_sql('c_custkey')} + 0.0001 <= {E}
  AND {lat_sql('c_custkey')} - 0.0001 >= {S} AND {lat_sql('c_custkey')} + 0.0001 <= {N}
  AND (c_mktsegment IN ('BUILDING', 'MACHINERY') OR (c_acctbal >= 0 AND n_name IN ('NATION_3', 'NATION_7')))
"""


def _nested(spark, folder):
    c = table(spark, folder, "customer").join(
        table(spark, folder, "nation"), F.col("n_nationkey") == F.col("c_nationkey")
    )
    x, y = lng(F.col("c_custkey")), lat(F.col("c_custkey"))
    none = F.lit(None).cast("array<string>")
    return c.select(
        F.col("c_custkey").alias("id"),
        F.struct(F.col("c_name").alias("primary")).alias("names"),
        F.struct(
            F.col("c_mktsegment").alias("primary"),
            F.when(F.col("c_acctbal") >= 0, F.array("n_name", F.lit(None).cast("string"))).alias("alternates"),
        ).alias("taxonomy"),
        F.col("c_acctbal").alias("confidence"),
        none.alias("websites"),
        none.alias("socials"),
        none.alias("phones"),
        F.struct(F.struct(F.lit("").alias("primary")).alias("names")).alias("brand"),
        F.array(
            F.struct(
                F.lit("").alias("freeform"),
                F.col("n_name").alias("locality"),
                F.lit("US-MA").alias("region"),
                F.lit("").alias("postcode"),
            )
        ).alias("addresses"),
        F.lit("open").alias("operating_status"),
        F.struct(
            (x - 0.0001).alias("xmin"), (x + 0.0001).alias("xmax"), (y - 0.0001).alias("ymin"), (y + 0.0001).alias("ymax")
        ).alias("bbox"),
    )


def _flat(nested):
    flat = coerce_places(scan_bbox(nested, BOX, ["BUILDING", "MACHINERY"], ["NATION_3", "NATION_7"]))
    return flat.select(
        "id",
        "name",
        "category",
        F.round("lng", 6).alias("lng"),
        F.round("lat", 6).alias("lat"),
        "locality",
        F.array_join("alternates", "|").alias("alternates"),
    )


@query("bbox_scan", _BOX_SQL)
def bbox_scan(spark, folder):
    return _flat(_nested(spark, folder))


@query("stored_box", _BOX_SQL)
def stored_box(spark, folder):
    """The same scan over stored nested Parquet, laid out along a Z-curve."""
    path = f"{ensure_checkpoint_dir(spark)}/places-{{release}}-{uuid.uuid4().hex}"
    write_places(_nested(spark, folder), path.replace("{release}", "r1"))
    return _flat(read_places(spark, path, "r1"))



@query(
    "category_inspect",
    """
SELECT p_type AS category, count(*) AS n, min(p_name) AS example FROM part
WHERE regexp_matches(lower(p_name), 'gear|ring|widget') OR p_type ILIKE '%eco%' OR p_type ILIKE '%pro%'
GROUP BY 1 ORDER BY n DESC, 1 LIMIT 40
""",
)
def category_inspect(spark, folder):
    return inspect_categories(
        table(spark, folder, "part"), F.col("p_type"), F.col("p_name"), "gear|ring|widget", ["%eco%", "%pro%"], k=40
    )


DENY = ["Red  Widget!", "old", "Blue Bólt", "small ri"]
DENY_SQL = "({n} = 'red widget' OR {n} LIKE 'red widget %' OR {n} = 'old' OR {n} LIKE 'old %' OR {n} = 'blue bolt' OR {n} LIKE 'blue bolt %' OR {n} = 'small ri' OR {n} LIKE 'small ri %')"


def _deny(spark):
    return spark.createDataFrame([(d,) for d in DENY], "phrase string")


@query(
    "deny_names",
    f"SELECT p_partkey, p_name FROM part WHERE {DENY_SQL.format(n=norm('p_name'))} OR {DENY_SQL.format(n=norm('p_brand'))}",
)
def deny_names(spark, folder):
    part = table(spark, folder, "part")
    ids = denied_ids(part, "p_partkey", [F.col("p_name"), F.col("p_brand")], _deny(spark))
    return part.join(ids, "p_partkey", "left_semi").select("p_partkey", "p_name")


def _judged(spark, folder):
    flat = places(spark, folder)
    hide = flat.filter("confidence > 0.97").select("id")
    marked = flag_ids(flat, "id", hide, "_hidden")
    marked = flag_ids(marked, "id", denied_ids(flat, "id", [F.col("name"), F.col("brand")], _deny(spark)), "_chain")
    return drop_cascade(
        marked,
        [
            ("no-name", F.trim("name") == ""),
            ("hidden", F.col("_hidden")),
            ("closed", F.col("operating_status").isin("permanently_closed", "closed")),
            ("low-confidence", F.col("confidence") < 0.2),
            ("chain", F.col("_chain")),
        ],
    )


CASCADE_SQL = f"""
judged AS (
  SELECT *, CASE WHEN trim(name) = '' THEN 'no-name'
                 WHEN confidence > 0.97 THEN 'hidden'
                 WHEN operating_status IN ('permanently_closed', 'closed') THEN 'closed'
                 WHEN confidence < 0.2 THEN 'low-confidence'
                 WHEN {DENY_SQL.format(n=norm('name'))} THEN 'chain' END AS reason
  FROM places
)"""


@query(
    "drop_cascade",
    f"WITH {PLACES_SQL}, {CASCADE_SQL} SELECT id, name, coalesce(reason, 'kept') AS reason FROM judged",
)
def cascade(spark, folder):
    return _judged(spark, folder).select("id", "name", F.coalesce("reason", F.lit("kept")).alias("reason"))


RADIUS = 800.0
GREEDY_SQL = f"""
{PLACES_SQL}, {CASCADE_SQL},
ranked AS (
  SELECT id, {norm('name')} AS key, lng, lat, confidence,
         row_number() OVER (PARTITION BY {norm('name')} ORDER BY -coalesce(confidence, 0), website IS NULL, id) AS n
  FROM judged WHERE reason IS NULL
),
greedy(key, n, id, kept, chosen) AS (
  SELECT key, 0::BIGINT, NULL::VARCHAR, false, []::STRUCT(id VARCHAR, x DOUBLE, y DOUBLE)[] FROM ranked WHERE n = 1
  UNION ALL
  SELECT g.key, r.n, r.id,
         len(list_filter(g.chosen, lambda c: {km('c.x', 'c.y', 'r.lng', 'r.lat')} * 1000 <= {RADIUS})) = 0,
         CASE WHEN len(list_filter(g.chosen, lambda c: {km('c.x', 'c.y', 'r.lng', 'r.lat')} * 1000 <= {RADIUS})) = 0
              THEN list_append(g.chosen, struct_pack(id := r.id, x := r.lng, y := r.lat)) ELSE g.chosen END
  FROM greedy g JOIN ranked r ON r.key = g.key AND r.n = g.n + 1
)"""


def _deduped(spark, folder):
    kept = _judged(spark, folder).filter("reason IS NULL")
    priority = [-F.coalesce(F.col("confidence"), F.lit(0.0)), F.col("website").isNull().cast("int")]
    by = (normalize_text(F.col("name")), F.col("lng"), F.col("lat"), priority, RADIUS)
    return spatial_dedupe(kept, "id", *by), by


@query(
    "spatial_dedupe",
    f"WITH RECURSIVE {GREEDY_SQL} SELECT id, kept FROM greedy WHERE n > 0",
)
def dedupe(spark, folder):
    judged, _ = _deduped(spark, folder)
    return judged.select("id", "kept")


@query(
    "duplicate_links",
    f"""WITH RECURSIVE {GREEDY_SQL},
kept AS (SELECT r.* FROM greedy g JOIN ranked r USING (id) WHERE g.kept)
SELECT d.id AS id, arg_min(k.id, k.n) AS duplicate_of
FROM greedy g JOIN ranked d USING (id) JOIN kept k ON k.key = d.key
     AND {km('k.lng', 'k.lat', 'd.lng', 'd.lat')} * 1000 <= {RADIUS}
WHERE NOT g.kept GROUP BY 1""",
)
def duplicate_links(spark, folder):
    judged, by = _deduped(spark, folder)
    return nearest_anchor(judged.filter("NOT kept"), judged.filter("kept"), "id", *by, as_name="duplicate_of")


@query(
    "patch_union",
    f"""WITH {PLACES_SQL}, {CASCADE_SQL},
patches AS (
  SELECT CAST(s_suppkey AS VARCHAR) AS id, s_name AS name,
         CASE WHEN s_acctbal > 5000 THEN 'roaster' END AS kind,
         CASE WHEN s_acctbal < 2000 THEN 'https://www.instagram.com/' || s_name
              WHEN s_acctbal > 7000 THEN 'HTTP://Patched.example.com/' || s_suppkey || '/?utm=1' END AS website
  FROM supplier)
SELECT j.id, coalesce(p.name, j.name) AS name, coalesce(p.kind, 'cafe') AS kind, 'places' AS source,
       CASE WHEN p.website IS NULL THEN j.website WHEN p.website LIKE 'HTTP:%' THEN 'http://patched.example.com/' || j.id END AS website
FROM judged j LEFT JOIN patches p ON p.id = j.id WHERE reason IS NULL
UNION ALL
SELECT 'manual-' || s_suppkey, s_name, 'both', 'manual', 'https://manual.example.com'
FROM supplier WHERE s_nationkey > 4 AND s_acctbal < 9000
""",
)
def patch_union(spark, folder):
    kept = _judged(spark, folder).filter("reason IS NULL")
    s = table(spark, folder, "supplier")
    none = F.lit(None).cast("string")
    patch = s.select(
        F.col("s_suppkey").cast("string").alias("id"),
        F.col("s_name").alias("name"),
        F.when(F.col("s_acctbal") > 5000, "roaster").alias("kind"),
        F.when(F.col("s_acctbal") < 2000, F.concat(F.lit("https://www.instagram.com/"), "s_name"))
        .when(
            F.col("s_acctbal") > 7000,
            F.concat(F.lit("HTTP://Patched.example.com/"), F.col("s_suppkey").cast("string"), F.lit("/?utm=1")),
        )
        .alias("website"),
        none.alias("platform"),
    )
    add = s.select(
        F.concat(F.lit("manual-"), F.col("s_suppkey").cast("string")).alias("id"),
        F.when(F.col("s_nationkey") > 4, "here").otherwise("elsewhere").alias("region_id"),
        F.col("s_name").alias("name"),
        F.lit("both").alias("kind"),
        F.lit(42.3).alias("lat"),
        F.lit(-71.1).alias("lng"),
        F.lit("1 Main St").alias("address"),
        F.lit("manual.example.com/#x").alias("website"),
    )
    hide = s.filter("s_acctbal >= 9000").select(F.concat(F.lit("manual-"), F.col("s_suppkey").cast("string")).alias("id"))
    candidates = kept.select("id", "name", F.lit("cafe").alias("kind"), "website", none.alias("platform"), F.lit("places").alias("source"))
    manual = manual_additions(add, hide, patch, "here")
    out = apply_patch(candidates, patch).unionByName(manual, allowMissingColumns=True)
    return out.select("id", "name", "kind", "source", "website")


@query(
    "multi_location",
    f"""WITH {PLACES_SQL}
SELECT arg_min(name, id) AS name, count(*) AS count FROM places GROUP BY {norm('name')} HAVING count(*) >= 5
""",
)
def multi(spark, folder):
    return multi_location(places(spark, folder), F.col("name"), ["id"], 5)


@query(
    "place_kinds",
    f"""WITH {PLACES_SQL}
SELECT id, CASE WHEN category = 'PROMO' OR brand = 'Brand#7'
                  OR regexp_matches({norm("CASE WHEN confidence > 0.6 THEN name || ' Roastérs' ELSE name END")}, '\\broast(er|ers|ery|eries|ing|works)\\b')
           THEN 'roaster' ELSE 'cafe' END AS kind FROM places""",
)
def place_kinds(spark, folder):
    name = F.when(F.col("confidence") > 0.6, F.concat("name", F.lit(" Roastérs"))).otherwise(F.col("name"))
    kind = detect_kind(name, F.col("category"), F.array("brand", F.lit(None).cast("string")), ["PROMO", "Brand#7"])
    return places(spark, folder).select("id", kind.alias("kind"))


@query(
    "candidate_projection",
    """
SELECT CAST(c_custkey AS VARCHAR) AS id, c_name AS name,
       CASE WHEN c_acctbal < 0 THEN NULL ELSE 'http://shop' || c_custkey || '.example.com/a/b' END AS website,
       CASE WHEN c_mktsegment = 'BUILDING' THEN NULL ELSE 'https://Instagram.com/C' || c_custkey END AS instagram,
       'MA' AS state, c_mktsegment AS phone, c_name AS city FROM customer""",
)
def candidate_projection(spark, folder):
    c = table(spark, folder, "customer")
    key = F.col("c_custkey").cast("string")
    shop = F.concat(F.lit("HTTP://Shop"), key, F.lit(".Example.com:8080/a/b/?q=1#top"))
    flat = c.select(
        key.alias("id"),
        F.concat(F.lit("  "), "c_name", F.lit("\t")).alias("name"),
        F.lit("cafe").alias("category"),
        F.array().cast("array<string>").alias("alternates"),
        F.lit(0.9).alias("confidence"),
        F.when(F.col("c_acctbal") < 0, F.array(F.lit("mailto:a@b.c"), F.lit("https://facebook.com/x")))
        .otherwise(F.array(F.lit("tel:+1"), F.lit("https://m.facebook.com/x"), shop))
        .alias("websites"),
        F.when(F.col("c_mktsegment") == "BUILDING", F.array(F.lit("https://x.com/a")))
        .otherwise(F.array(F.lit("https://x.com/a"), F.concat(F.lit("https://Instagram.com/C"), key, F.lit("/?hl=en"))))
        .alias("socials"),
        F.array("c_mktsegment", F.lit("second")).alias("phones"),
        F.lit("1 Main St").alias("street"),
        F.col("c_name").alias("locality"),
        F.lit("us-ma").alias("region"),
        F.lit("02139").alias("postcode"),
        F.lit(1.0).alias("lng"),
        F.lit(2.0).alias("lat"),
    )
    return project_candidate(flat, "here", ["coffee_roastery"]).select(
        "id", "name", "website", "instagram", F.col("address.state").alias("state"), "phone", F.col("address.city").alias("city")
    )


@query(
    "clean_urls",
    r"""
SELECT page_id, regexp_replace(regexp_replace(url, '[?#].*$', ''), '/+$', '') AS website,
       regexp_replace(regexp_extract(url, '^https?://([^/?#]+)', 1), '^www\.', '') AS host,
       regexp_extract(url, '^https?://[^/?#]*([^?#]*)', 1) AS path FROM pages""",
)
def clean_urls(spark, folder):
    u = F.col("url")
    return table(spark, folder, "pages").select(
        "page_id", clean_url(u).alias("website"), host_of(u).alias("host"), path_of(u).alias("path")
    )


_X = "(CAST(-75.5 AS DOUBLE) + CAST(c_custkey * 7919 % 50000 AS DOUBLE) / 1e4)"
_Y = "(CAST(39.5 AS DOUBLE) + CAST(c_custkey * 104729 % 30000 AS DOUBLE) / 1e4)"
_REGION_KM = [f"{km(_X, _Y, str(r.center[0]), str(r.center[1]))}" for r in REGIONS]


@query(
    "nearest_region",
    f"""
WITH d AS (SELECT c_custkey, {', '.join(f'{k} AS {r.id}' for k, r in zip(_REGION_KM, REGIONS))} FROM customer)
SELECT c_custkey, CASE WHEN nyc <= philadelphia AND nyc <= boston THEN 'nyc' WHEN philadelphia <= boston THEN 'philadelphia' ELSE 'boston' END AS region_id,
       round(least(nyc, philadelphia, boston), 6) AS km, least(nyc, philadelphia, boston) <= 50 AS in_range FROM d""",
)
def nearest(spark, folder):
    key = F.col("c_custkey")
    points = table(spark, folder, "customer").select(
        key,
        (F.lit(-75.5) + ((key * 7919) % 50000).cast("double") / 1e4).alias("lng"),
        (F.lit(39.5) + ((key * 104729) % 30000).cast("double") / 1e4).alias("lat"),
    )
    out = nearest_region(points, F.col("lng"), F.col("lat"))
    return out.select("c_custkey", "region_id", F.round("km", 6).alias("km"), "in_range")


def _geohash_sql(x: str, y: str, precision: int) -> str:
    total = 5 * precision
    xb, yb = (total + 1) // 2, total // 2
    ix = f"least(greatest(CAST(floor(({x} + 180) / 360 * {float(1 << xb)}) AS BIGINT), 0), {(1 << xb) - 1})"
    iy = f"least(greatest(CAST(floor(({y} + 90) / 180 * {float(1 << yb)}) AS BIGINT), 0), {(1 << yb) - 1})"
    letters = []
    for k in range(precision):
        bits = []
        for i in range(5 * k, 5 * k + 5):
            axis, n = ("ix", xb) if i % 2 == 0 else ("iy", yb)
            bits.append(f"((({axis} >> {n - 1 - i // 2}) & 1) << {4 - i % 5})")
        letters.append(f"substr('{BASE32}', 1 + CAST({' + '.join(bits)} AS INTEGER), 1)")
    return f"(SELECT *, {' || '.join(letters)} AS cell FROM (SELECT *, {ix} AS ix, {iy} AS iy FROM customer))"


@query(
    "geohash_cells",
    f"SELECT cell, count(*) AS points FROM {_geohash_sql(lng_sql('c_custkey'), lat_sql('c_custkey'), 6)} GROUP BY cell",
)
def geohashes(spark, folder):
    key = F.col("c_custkey")
    points = table(spark, folder, "customer").select(lng(key).alias("lng"), lat(key).alias("lat"))
    return geohash_cells(points, 6)


_ZOOM_CELLS = float((1 << 11) * 11)


@query(
    "map_clusters",
    f"""
WITH p AS (SELECT {lng_sql('c_custkey')} AS lng, {lat_sql('c_custkey')} AS lat FROM customer)
SELECT CAST(floor((lng + 180) / 360 * {_ZOOM_CELLS}) AS BIGINT) AS x,
       CAST(floor((1 - ln(tan(radians(lat)) + 1 / cos(radians(lat))) / pi()) / 2 * {_ZOOM_CELLS}) AS BIGINT) AS y,
       count(*) AS points, round(avg(lng), 9) AS lng, round(avg(lat), 9) AS lat FROM p GROUP BY 1, 2""",
)
def clusters(spark, folder):
    key = F.col("c_custkey")
    points = table(spark, folder, "customer").select(lng(key).alias("lng"), lat(key).alias("lat"))
    out = grid_clusters(points, 11)
    return out.select("x", "y", "points", F.round("lng", 9).alias("lng"), F.round("lat", 9).alias("lat"))


@query(
    "map_pyramid",
    "SELECT CAST(zoom AS INTEGER) AS zoom, (SELECT count(*) FROM customer) AS points, CAST(0 AS BIGINT) AS torn FROM range(15) AS t(zoom)",
)
def pyramid(spark, folder):
    """Points of each level, and its clusters that are not the sum of theirs of the level below."""
    key = F.col("c_custkey")
    levels = cluster_pyramid(table(spark, folder, "customer"), "c_custkey", lng(key), lat(key))
    below = levels.filter("zoom > 0").groupBy((F.col("zoom") - 1).alias("zoom"), F.col("parent_id").alias("cluster_id")).agg(F.sum("points").alias("below"))
    joined = levels.join(below, ["zoom", "cluster_id"], "full")
    torn = (F.col("zoom") < CLUSTER_MAX_ZOOM) & ~F.col("points").eqNullSafe(F.col("below"))
    return joined.groupBy("zoom").agg(F.sum("points").alias("points"), F.count_if(torn).alias("torn"))


@query(
    "bounds",
    f"""
SELECT round(min({lng_sql('c_custkey')}), 6) AS west, round(min({lat_sql('c_custkey')}), 6) AS south,
       round(max({lng_sql('c_custkey')}), 6) AS east, round(max({lat_sql('c_custkey')}), 6) AS north FROM customer""",
)
def bounds(spark, folder):
    key = F.col("c_custkey")
    out = bounds_of(table(spark, folder, "customer").select(lng(key).alias("lng"), lat(key).alias("lat")))
    return out.select(*[F.round(c, 6).alias(c) for c in out.columns])


@query(
    "regions_by_state",
    """
SELECT r_name AS state, string_agg(CAST(n_nationkey AS VARCHAR), '|' ORDER BY n_name) AS regions
FROM nation JOIN region ON r_regionkey = n_regionkey GROUP BY 1""",
)
def by_state(spark, folder):
    joined = table(spark, folder, "nation").join(
        table(spark, folder, "region"), F.col("r_regionkey") == F.col("n_regionkey")
    )
    rows = joined.select(
        F.col("r_name").alias("state"), F.col("n_name").alias("name"), F.col("n_nationkey").cast("string").alias("region_id")
    )
    return regions_by_state(rows).select("state", F.array_join("regions", "|").alias("regions"))


@query(
    "distance",
    f"""
SELECT l_orderkey, l_linenumber, round({km(lng_sql('l_suppkey'), lat_sql('l_suppkey'), lng_sql('o_custkey'), lat_sql('o_custkey'))}, 6) AS km
FROM lineitem JOIN orders ON o_orderkey = l_orderkey""",
)
def distance(spark, folder):
    """Between the supplier and the customer of each order line: one pair a line."""
    lines = table(spark, folder, "lineitem").join(table(spark, folder, "orders"), F.col("o_orderkey") == F.col("l_orderkey"))
    a, b = F.col("l_suppkey"), F.col("o_custkey")
    return lines.select("l_orderkey", "l_linenumber", F.round(haversine_km(lng(a), lat(a), lng(b), lat(b)), 6).alias("km"))
