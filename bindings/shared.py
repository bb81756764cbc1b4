"""Tables that several bindings derive from the test data, in Spark and in SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from bindings import table
from cartolex.vocab.countries import COUNTRIES

BOX = (-71.15, 42.26, -71.02, 42.39)
ORIGIN = (-71.0789, 42.3601)

# Haversine distance in km between (x1, y1) and (x2, y2).
KM = (
    "2 * 6371.0 * asin(sqrt(least(pow(sin(radians({y2} - {y1}) / 2), 2) + cos(radians({y1})) * cos(radians({y2}))"
    " * pow(sin(radians({x2} - {x1}) / 2), 2), 1.0)))"
)

# normalize_text: accents off, lower case, apostrophes dropped, single spaces.
NORM = (
    "trim(regexp_replace(regexp_replace(lower(strip_accents({0})), '[''’]', '', 'g'), '[^a-z0-9]+', ' ', 'g'))"
)


def norm(expr: str) -> str:
    return NORM.format(expr)


def km(x1: str, y1: str, x2: str, y2: str) -> str:
    return KM.format(x1=x1, y1=y1, x2=x2, y2=y2)


def lng(key: Column) -> Column:
    return F.lit(-71.191) + ((key * 7919) % 2050).cast("double") / 1e4


def lat(key: Column) -> Column:
    return F.lit(42.227) + ((key * 104729) % 1930).cast("double") / 1e4


def lng_sql(key: str) -> str:
    return f"(CAST(-71.191 AS DOUBLE) + CAST({key} * 7919 % 2050 AS DOUBLE) / 1e4)"


def lat_sql(key: str) -> str:
    return f"(CAST(42.227 AS DOUBLE) + CAST({key} * 104729 % 1930 AS DOUBLE) / 1e4)"


# A place per customer, named after the part with the same number.
PLACES_SQL = f"""
places AS (
  SELECT CAST(c_custkey AS VARCHAR) AS id,
         CASE WHEN p_size = 1 THEN ' ' ELSE p_name END AS name,
         p_type AS category, p_brand AS brand,
         (c_acctbal + 1000.0) / 11000.0 AS confidence,
         CASE WHEN p_size > 46 THEN 'closed' WHEN p_size = 46 THEN 'permanently_closed' END AS operating_status,
         CASE WHEN c_acctbal > 5000 THEN 'https://shop' || c_custkey || '.example.com' END AS website,
         {lng_sql('c_custkey')} AS lng, {lat_sql('c_custkey')} AS lat
  FROM customer JOIN part ON p_partkey = c_custkey
)"""


def places(spark: SparkSession, folder: str) -> DataFrame:
    joined = table(spark, folder, "customer").join(
        table(spark, folder, "part"), F.col("p_partkey") == F.col("c_custkey")
    )
    key = F.col("c_custkey")
    return joined.select(
        key.cast("string").alias("id"),
        F.when(F.col("p_size") == 1, " ").otherwise(F.col("p_name")).alias("name"),
        F.col("p_type").alias("category"),
        F.col("p_brand").alias("brand"),
        ((F.col("c_acctbal") + 1000.0) / 11000.0).alias("confidence"),
        F.when(F.col("p_size") > 46, "closed").when(F.col("p_size") == 46, "permanently_closed").alias("operating_status"),
        F.when(F.col("c_acctbal") > 5000, F.concat(F.lit("https://shop"), key.cast("string"), F.lit(".example.com"))).alias("website"),
        lng(key).alias("lng"),
        lat(key).alias("lat"),
    )


ROAST_OF_TYPE = {
    "ECONOMY": "light",
    "SMALL": "medium-light",
    "MEDIUM": "medium",
    "LARGE": "medium-dark",
    "STANDARD": "dark",
    "PROMO": "omni",
}
PROCESS_OF_PRIORITY = {
    "1-URGENT": "washed",
    "2-HIGH": "natural",
    "3-MEDIUM": "honey",
    "4-NOT SPECIFIED": "anaerobic",
    "5-LOW": "other",
}
CODES = list(COUNTRIES)[:20]


def case(column: str, labels: dict[str, str]) -> str:
    return "CASE " + " ".join(f"WHEN {column} = '{k}' THEN '{v}'" for k, v in labels.items()) + " END"


def values(rows: list[tuple]) -> str:
    def text(v) -> str:
        return "NULL" if v is None else str(v) if isinstance(v, (int, float)) else "'" + v.replace("'", "''") + "'"

    return "(VALUES " + ", ".join("(" + ", ".join(text(v) for v in r) + ")" for r in rows) + ")"


# Items of a customer: the lines of their orders.
ITEMS_SQL = f"""
items AS (
  SELECT o_custkey AS entity_id, p_name AS name,
         {case('p_type', ROAST_OF_TYPE)} AS roast_level,
         {case('o_orderpriority', PROCESS_OF_PRIORITY)} AS process,
         CASE WHEN s_nationkey < {len(CODES)} THEN [code] ELSE ['XX'] END AS countries,
         [split_part(p_name, ' ', 1) || '/' || split_part(p_name, ' ', 2)] AS flavor_families,
         [lower(p_brand)] AS varieties,
         l_returnflag = 'R' AS is_decaf,
         CASE WHEN l_linestatus = 'O' AND l_quantity > 49 THEN 'https://example.com/p/' || p_partkey END AS url
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey
  JOIN supplier ON l_suppkey = s_suppkey
  LEFT JOIN {values([(i, c) for i, c in enumerate(CODES)])} AS codes(n, code) ON n = s_nationkey
)"""


def items(spark: SparkSession, folder: str) -> DataFrame:
    lines = table(spark, folder, "lineitem")
    joined = (
        lines.join(table(spark, folder, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
        .join(table(spark, folder, "part"), F.col("l_partkey") == F.col("p_partkey"))
        .join(table(spark, folder, "supplier"), F.col("l_suppkey") == F.col("s_suppkey"))
    )
    words = F.split("p_name", " ")

    def labelled(column: str, labels: dict[str, str]) -> Column:
        out = F
        for k, v in labels.items():
            out = out.when(F.col(column) == k, F.lit(v))
        return out

    codes = F.array(*[F.lit(c) for c in CODES])
    code = F.coalesce(F.get(codes, F.col("s_nationkey")), F.lit("XX"))
    return joined.select(
        F.col("o_custkey").alias("entity_id"),
        F.col("p_name").alias("name"),
        labelled("p_type", ROAST_OF_TYPE).alias("roast_level"),
        labelled("o_orderpriority", PROCESS_OF_PRIORITY).alias("process"),
        F.array(code).alias("countries"),
        F.array(F.concat_ws("/", words[0], words[1])).alias("flavor_families"),
        F.array(F.lower("p_brand")).alias("varieties"),
        (F.col("l_returnflag") == "R").alias("is_decaf"),
        F.when(
            (F.col("l_linestatus") == "O") & (F.col("l_quantity") > 49),
            F.concat(F.lit("https://example.com/p/"), F.col("p_partkey").cast("string")),
        ).alias("url"),
    )


FACET_LISTS = ("roast_levels", "processes", "origin_countries", "flavor_families", "varieties")

# The index: customers with the facets of their items.
INDEX_SQL = f"""{ITEMS_SQL},
per_entity AS (
  SELECT entity_id, count(*) AS bean_count, bool_or(url IS NOT NULL) AS any_url, bool_or(is_decaf) AS decaf,
         list_sort(list_distinct(list(roast_level))) AS roast_levels,
         list_sort(list_distinct(list(process))) AS processes,
         list_sort(list_distinct(flatten(list(countries)))) AS origin_countries,
         list_sort(list_distinct(flatten(list(flavor_families)))) AS flavor_families,
         list_sort(list_distinct(flatten(list(varieties)))) AS varieties
  FROM items GROUP BY entity_id
),
facets AS (
  SELECT c_custkey AS id, c_name AS name, {lng_sql('c_custkey')} AS lng, {lat_sql('c_custkey')} AS lat,
         CASE WHEN c_mktsegment = 'BUILDING' THEN 'roaster'
              WHEN c_mktsegment IN ('MACHINERY', 'FURNITURE') AND bean_count > 0
                   AND (c_acctbal > 9000 OR any_url) THEN 'both' ELSE 'cafe' END AS kind,
         CASE WHEN bean_count > 0 THEN 'beans' WHEN c_acctbal > 0 THEN 'menu-only' ELSE 'none' END AS data_status,
         coalesce(bean_count, 0) AS bean_count,
         coalesce(bean_count > 0 AND (c_acctbal > 9000 OR any_url), false) AS sells_online,
         {', '.join(f"coalesce({c}, []::VARCHAR[]) AS {c}" for c in FACET_LISTS)},
         coalesce(decaf, false) AS has_decaf, c_nationkey
  FROM customer LEFT JOIN per_entity ON entity_id = c_custkey
)"""


def index(spark: SparkSession, folder: str) -> DataFrame:
    from cartolex.operators.entities import compute_facets

    customers, menu, platform = entities_of(spark, folder)
    return indexed(compute_facets(customers, items(spark, folder), menu, "entity_id", platform))


def entities_of(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame, Column]:
    """Customers as entities, those with a menu, and the platform of each."""
    customers = table(spark, folder, "customer").withColumnRenamed("c_custkey", "entity_id")
    menu = customers.filter("c_acctbal > 0").select("entity_id")
    return customers, menu, F.when(F.col("c_acctbal") > 9000, F.lit("shopify")).otherwise(F.lit("other"))


def indexed(out: DataFrame) -> DataFrame:
    """Entities with facets as rows of the index."""
    upgraded = F.col("c_mktsegment").isin("MACHINERY", "FURNITURE") & F.col("sells_online")
    return out.select(
        F.col("entity_id").alias("id"),
        F.col("c_name").alias("name"),
        F.when(F.col("c_mktsegment") == "BUILDING", F.lit("roaster"))
        .when(upgraded, F.lit("both"))
        .otherwise(F.lit("cafe"))
        .alias("kind"),
        lng(F.col("entity_id")).alias("lng"),
        lat(F.col("entity_id")).alias("lat"),
        "data_status",
        "bean_count",
        "sells_online",
        *FACET_LISTS,
        "has_decaf",
        "c_nationkey",
    )
