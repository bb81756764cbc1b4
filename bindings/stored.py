"""What is written and read again, what is checked, and what comes in an order."""

from __future__ import annotations

import uuid

from pyspark.sql import Window
from pyspark.sql import functions as F

from bindings import query, table
from cartolex.functions.display import top_families
from cartolex.functions.hashing import strip_volatile
from cartolex.functions.taxonomy import children, roots
from cartolex.operators.corpus import detect_platform
from cartolex.operators.discover import order_by_name
from cartolex.operators.facets import Filters, order_items
from cartolex.operators.keep import limit_first
from cartolex.session import ensure_checkpoint_dir
from cartolex.sources.dims import ADD_SCHEMA, PATCH_SCHEMA, override_problems
from cartolex.sources.export import write_json
from cartolex.sources.published import find, manifest, publish, read_published
from cartolex.sources.snapshots import load_index, lookup_entity, write_index


def _folder(spark, name: str) -> str:
    return f"{ensure_checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"


def _regions(spark, folder):
    c = table(spark, folder, "customer").join(table(spark, folder, "nation"), F.col("n_nationkey") == F.col("c_nationkey"))
    return c.select(F.col("c_custkey").cast("string").alias("id"), F.col("c_name").alias("name"), F.col("c_acctbal").alias("balance"), F.col("n_regionkey").cast("string").alias("region_id"))


_REGIONS_SQL = "r AS (SELECT CAST(c_custkey AS VARCHAR) AS id, c_name AS name, c_acctbal AS balance, CAST(n_regionkey AS VARCHAR) AS region_id FROM customer JOIN nation ON n_nationkey = c_nationkey)"


@query(
    "stored_index",
    f"""WITH {_REGIONS_SQL}
SELECT id, name, region_id FROM r WHERE region_id IN ('0', '3') OR (region_id = '1' AND balance > 0)""",
)
def stored_index(spark, folder):
    """All regions published, then regions 1 and 2 again: the one with fewer rows, the other with none."""
    path, rows = _folder(spark, "index"), _regions(spark, folder)
    write_index(rows, path)
    write_index(rows.filter("region_id = '1' AND balance > 0"), path, regions=["1", "2"])
    shown = [load_index(spark, path, r).select("id", "name", F.col("region_id").cast("string").alias("region_id")) for r in ("0", "1", "2", "3")]
    return shown[0].unionByName(shown[1]).unionByName(shown[2]).unionByName(shown[3])


@query("stored_lookup", f"WITH {_REGIONS_SQL} SELECT id, name FROM r WHERE id = '7'")
def stored_lookup(spark, folder):
    path = _folder(spark, "index")
    write_index(_regions(spark, folder), path)
    return lookup_entity(spark.read.parquet(path), "id", "7").select("id", "name")


@query(
    "published_index",
    f"""WITH {_REGIONS_SQL}
SELECT id, name, region_id, CAST(CASE WHEN region_id IN ('1', '2') THEN 2 ELSE 1 END AS INTEGER) AS version FROM r
WHERE region_id IN ('0', '3', '4') OR (region_id = '1' AND balance > 0)""",
)
def published_index(spark, folder):
    """All regions in one version, then regions 1 and 2 in the next: one with fewer rows, the other with none."""
    path, rows = _folder(spark, "published"), _regions(spark, folder)
    publish(rows.withColumn("version", F.lit(1)), path)
    publish(rows.filter("region_id = '1' AND balance > 0").withColumn("version", F.lit(2)), path, regions=["1", "2"])
    return read_published(spark, path).select("id", "name", "region_id", "version")


@query(
    "published_counts",
    f"WITH {_REGIONS_SQL} SELECT region_id, count(*) AS rows FROM r WHERE balance > 0 GROUP BY 1",
)
def published_counts(spark, folder):
    """Rows of each region as the manifest has them."""
    path = _folder(spark, "published")
    publish(_regions(spark, folder).filter("balance > 0"), path)
    held = manifest(spark, path)["regions"]
    return spark.createDataFrame([(r, v["rows"]) for r, v in held.items()], "region_id string, rows long")


@query("published_lookup", f"WITH {_REGIONS_SQL} SELECT id, name, region_id FROM r WHERE id = '42'")
def published_lookup(spark, folder):
    path = _folder(spark, "published")
    publish(_regions(spark, folder), path)
    return find(spark, path, "42").select("id", "name", "region_id")


@query("json_files", f"WITH {_REGIONS_SQL} SELECT region_id, count(*) AS rows, min(name) AS first, max(balance) AS most FROM r GROUP BY 1")
def json_files(spark, folder):
    path, rows = _folder(spark, "json"), _regions(spark, folder)
    write_json(rows, path)
    back = spark.read.schema(rows.schema).json(path).withColumn("region_id", F.col("region_id").cast("string"))
    return back.groupBy("region_id").agg(F.count("*").alias("rows"), F.min("name").alias("first"), F.max("balance").alias("most"))


@query(
    "override_problems",
    """
SELECT 'add' AS section, 'manual-' || s_suppkey AS id, CASE WHEN s_acctbal < 0 THEN 'missing field' ELSE 'unknown kind' END AS problem
FROM supplier WHERE s_suppkey % 3 <> 0 AND (s_acctbal < 0 OR s_nationkey > 20)
UNION ALL
SELECT 'add', 's' || s_suppkey, CASE WHEN s_acctbal < 0 THEN 'missing field' WHEN s_nationkey > 20 THEN 'unknown kind' ELSE 'id must start with manual-' END
FROM supplier WHERE s_suppkey % 3 = 0
UNION ALL
SELECT 'patch', CAST(s_suppkey AS VARCHAR), 'unknown kind' FROM supplier WHERE s_nationkey > 20""",
)
def problems(spark, folder):
    s = table(spark, folder, "supplier")
    key = F.col("s_suppkey").cast("string")
    kind = F.when(F.col("s_nationkey") > 20, "castle").otherwise("cafe")
    add = s.select(
        F.when(F.col("s_suppkey") % 3 == 0, F.concat(F.lit("s"), key)).otherwise(F.concat(F.lit("manual-"), key)).alias("id"),
        F.lit("here").alias("region_id"),
        F.when(F.col("s_acctbal") < 0, F.lit(" ")).otherwise(F.col("s_name")).alias("name"),
        kind.alias("kind"),
        F.lit(1.0).alias("lat"),
        F.lit(2.0).alias("lng"),
        F.lit(None).cast("string").alias("address"),
        F.lit(None).cast("string").alias("website"),
    )
    none = F.lit(None).cast("string")
    patch = s.select(key.alias("id"), none.alias("name"), F.when(F.col("s_nationkey") > 20, "castle").alias("kind"), none.alias("website"), none.alias("platform"))
    assert add.columns == [c.split()[0] for c in ADD_SCHEMA.split(", ")] and patch.columns == [c.split()[0] for c in PATCH_SCHEMA.split(", ")]
    return override_problems(add, patch)


@query(
    "item_order",
    """
WITH i AS (
  SELECT o_custkey AS entity_id, l_orderkey * 10 + l_linenumber AS key, p_name AS name, coalesce(o_orderpriority = '2-HIGH', false) AS wanted,
         CASE l_returnflag WHEN 'R' THEN false WHEN 'A' THEN true END AS in_stock
  FROM lineitem JOIN orders ON o_orderkey = l_orderkey JOIN part ON p_partkey = l_partkey)
SELECT entity_id, key, row_number() OVER (PARTITION BY entity_id ORDER BY wanted DESC, coalesce(in_stock, true) DESC, name, key) AS rank FROM i""",
)
def item_order(spark, folder):
    """The place of each item within its entity in the order that comes out."""
    lines = table(spark, folder, "lineitem").join(table(spark, folder, "orders"), F.col("o_orderkey") == F.col("l_orderkey"))
    parts = lines.join(table(spark, folder, "part"), F.col("p_partkey") == F.col("l_partkey"))
    rows = parts.select(
        F.col("o_custkey").alias("entity_id"),
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("key"),
        F.col("p_name").alias("name"),
        F.when(F.col("o_orderpriority") == "2-HIGH", "natural").otherwise("washed").alias("process"),
        F.when(F.col("l_returnflag") == "R", False).when(F.col("l_returnflag") == "A", True).alias("in_stock"),
    )
    ordered = order_items(rows, Filters(processes=["natural"]), ["entity_id"], "key")
    # Ids rise along a sorted frame: ranks by them show its order.
    placed = ordered.select("entity_id", "key", F.monotonically_increasing_id().alias("place"))
    rank = F.row_number().over(Window.partitionBy("entity_id").orderBy("place"))
    return placed.select("entity_id", "key", rank.cast("bigint").alias("rank"))


@query(
    "first_names",
    "SELECT c_custkey AS id, c_name AS name, row_number() OVER (ORDER BY c_name, c_custkey) AS rank FROM customer ORDER BY 3 LIMIT 100",
)
def first_names(spark, folder):
    """The first hundred names in locale-aware order, with their ranks."""
    named = table(spark, folder, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"))
    first, complete = limit_first(named, [F.collate(F.col("name"), "UNICODE"), F.col("id")], 100)
    assert not complete
    placed = order_by_name(first).withColumn("place", F.monotonically_increasing_id())
    return placed.select("id", "name", F.row_number().over(Window.orderBy("place")).cast("bigint").alias("rank"))


@query(
    "platform_headers",
    """
SELECT page_id, CASE WHEN page_id % 5 = 0 THEN 'pinned' WHEN page_id % 3 = 0 THEN 'shopify' WHEN page_id % 3 = 1 AND contains(html, 'lang="fr"') THEN 'woocommerce' ELSE 'other' END AS platform
FROM pages""",
)
def platform_headers(spark, folder):
    """A pinned value goes before a response header, a header before the page."""
    sent = F.when(F.col("page_id") % 3 == 0, "Shop-Host-7").when(F.col("page_id") % 3 == 1, "nginx")
    pages = table(spark, folder, "pages").withColumns(
        {
            "headers": F.create_map(F.lit("X-Powered-BY"), F.coalesce(sent, F.lit("none"))),
            "pin": F.when(F.col("page_id") % 5 == 0, "pinned"),
            "html": F.when(F.col("page_id") % 3 == 1, F.col("html")).otherwise(""),
        }
    )
    found = detect_platform(pages, pinned="pin", markers=[('lang="fr"', "woocommerce")], headers="headers", header_markers=[("x-powered-by", "(?i)^shop-host", "shopify")])
    return found.select("page_id", "platform")


@query(
    "taxonomy_parts",
    """
WITH t AS (SELECT DISTINCT p_type AS id FROM part UNION SELECT DISTINCT p_type || '/' || p_brand FROM part)
SELECT CASE WHEN contains(id, '/') THEN 'child' ELSE 'root' END AS part, id FROM t WHERE NOT contains(id, '/') OR starts_with(id, 'ECONOMY/')""",
)
def taxonomy_parts(spark, folder):
    part = table(spark, folder, "part")
    ids = part.select(F.col("p_type").alias("id")).unionByName(part.select(F.concat_ws("/", "p_type", "p_brand").alias("id"))).distinct()
    return roots(ids).select(F.lit("root").alias("part"), "id").unionByName(children(ids, "ECONOMY").select(F.lit("child").alias("part"), "id"))


@query(
    "family_labels",
    """
SELECT c_custkey, CASE c_custkey % 4 WHEN 0 THEN 'Fruity|Sweet' WHEN 1 THEN 'Spices|Roasted|Fruity' WHEN 2 THEN '' ELSE 'Nutty / cocoa' END AS labels FROM customer""",
)
def family_labels(spark, folder):
    """Labels of at most three top-level families."""
    kind = F.col("c_custkey") % 4
    listed = lambda *names: F.array(*[F.lit(n) for n in names])
    families = (
        F.when(kind == 0, listed("fruity/berry", "sweet", "fruity/citrus"))
        .when(kind == 1, listed("spices", "roasted", "fruity", "sweet/vanilla"))
        .when(kind == 2, F.array().cast("array<string>"))
        .otherwise(listed("nutty-cocoa/cocoa", "nutty-cocoa/nutty"))
    )
    return table(spark, folder, "customer").select("c_custkey", F.array_join(top_families(families), "|").alias("labels"))


@query(
    "stable_part",
    "SELECT c_custkey, sha256('{\"c_name\":\"' || c_name || '\"}') AS hash FROM customer",
)
def stable_part(spark, folder):
    """What is left of a row without its volatile columns decides its hash."""
    named = table(spark, folder, "customer").select("c_custkey", "c_name", F.lit("2024-01-01").alias("lastSeen"))
    bare = strip_volatile(named, frozenset({"lastSeen"}))
    return bare.select("c_custkey", F.sha2(F.to_json(F.struct("c_name")), 256).alias("hash"))
